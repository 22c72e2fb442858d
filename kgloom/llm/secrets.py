"""Secret scanning through a trigram inverted index, in DataFrame functions only.

For every rule, a Boolean query of trigrams is derived from its expression: an
OR over its alternatives of an AND over the trigrams that each must hold.  Of
each AND the trigram that is rarest in English is its pivot, whose posting list
is taken first: a document in no pivot's list is a candidate of no rule, and its
row passes straight through.  For the others the index has a posting ``(trigram,
document)`` for each trigram of the queries that the lower-cased text contains.
Postings of a query are intersected by counting, the candidates are joined back to
their texts, and only there the expressions run.  Rules without a mandatory
trigram scan every text where it stands.

Spans are in code points with an exclusive end, leftmost and non-overlapping in
each kind.  The positions are the running sums of the lengths of what
``split`` leaves between the matches and of the matches.

Defined results: null text counts as empty and has no spans; rows that share a key
are candidates together and verified each by its own text; rows with a null key
skip the index and are scanned fully; columns of the input other than key and
text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Rule:
    """``pattern`` for Java; a match fails if its ``group`` has less than ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_LABEL = r"[A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
#: A key from BEGIN to END; without END its header lines and the base64 that follows, to a short last line and a checksum.
#: Loops over groups are possessive, which Java runs without recursion; none passes a further ``-----``.
PRIVATE = (
    rf"-----BEGIN {_LABEL}(?:(?:[^-]++|-(?!----))*+-----END {_LABEL}"
    r"|(?:(?:[\s>]|\\[nr])*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+)*+"
    r"(?:(?:[\s>]|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++"
    r"(?:(?:\r?\n|\\n)[\x20>]*+[A-Za-z0-9+/]{1,15}+(?=\x20*+[\r\n\\]|(?![\s\S])))?+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{0,15}+={1,2}+[A-Za-z0-9+/]{0,4}+){0,2}+)?"
)
#: The base rules first, in the order of their kinds (fixed patterns), then those the method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private", PRIVATE),
    Rule("repo", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")
#: A derived query has at most so many alternatives; beyond, a part of the expression counts as unknown text, which can only
#: add candidates.  No rule above has so many.
MOST_ALTERNATIVES = 64
#: The letters of English from the most frequent on (fixed values).
FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"


def literals(pattern: str) -> list[list[str]] | None:
    """The literal runs that any match must hold: alternatives of lists of runs; None if unknown.

    The expression is read with Python's parser, which agrees with Java's for
    what the rules use.  Anything but literals, small sets, groups and branches
    ends a run.
    """
    try:
        from re import _constants as op
        from re import _parser as parser
    except ImportError:  # Python before 3.11
        import sre_constants as op
        import sre_parse as parser

    def cross(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
        """A run at the end of one side goes on at the start of the other."""
        return [[*x[:-1], x[-1] + y[0], *y[1:]] for x in a for y in b]

    def walk(seq) -> list[list[str]]:
        out = [[""]]
        for kind, arg in seq:
            if kind is op.LITERAL:
                part = [[chr(arg)]]
            elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
                part = [[chr(c)] for _, c in arg]
            elif kind is op.SUBPATTERN:
                part = walk(arg[-1])
            elif kind is op.BRANCH:
                part = [x for branch in arg[1] for x in walk(branch)]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is op.LITERAL:
                part = [[""], [chr(arg[2][0][1])]]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] == arg[1] and arg[0] <= 8:
                part = walk(list(arg[2]) * arg[0])
            elif kind is op.AT:
                continue
            else:
                part = [["", ""]]
            if len(out) * len(part) > MOST_ALTERNATIVES:
                part = [["", ""]]
            out = cross(out, part)
        return out

    try:
        return walk(parser.parse(pattern))
    except re.error:
        return None


def trigram_query(pattern: str) -> list[list[str]]:
    """The query of a rule: alternatives of sorted trigrams, all of which must occur; empty if it has none."""
    clauses = set()
    for runs in literals(pattern) or [[]]:
        grams = {run[i : i + 3].lower() for run in runs for i in range(len(run) - 2) if run.isascii()}
        if not grams:
            return []
        clauses.add(frozenset(grams))
    return sorted(sorted(c) for c in clauses if not any(d < c for d in clauses))


def pivot(clause: list[str]) -> str:
    """The trigram of a clause that should have the shortest posting list; the choice changes the cost only."""
    return max(clause, key=lambda g: (sum(FREQUENCY.index(c) if c in FREQUENCY else 40 for c in g), g))


def in_a_pivots_list(text, rules: tuple[Rule, ...]):
    """Whether the text is in the posting list of a pivot."""
    pivots = sorted({pivot(c) for rule in rules for c in trigram_query(rule.pattern)})

    def any_of(low):
        out = F.lit(False)
        for g in pivots:
            out = out | F.contains(low, F.lit(g))
        return out

    return F.exists(F.array(F.lower(text)), any_of)  # an array, so that the text is lower-cased once


def postings(docs: DataFrame, trigrams: list[str], key: str = "k", text: str = "t") -> DataFrame:
    """The index: ``trigram, key`` for each of ``trigrams`` in each lower-cased text."""
    lowered = docs.select(key, F.lower(text).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(n)) for n, g in enumerate(trigrams)]))
    return lowered.select(F.explode(held).alias("trigram"), key)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "k", text: str = "t") -> DataFrame:
    """``key, rules``: a bit for each rule whose query the texts of the key fulfil.

    A row for each document and clause is the most that a key can have, so no
    posting list is gathered in one place.
    """
    queries = [(n, c) for n, rule in enumerate(rules) for c in trigram_query(rule.pattern)]
    trigrams = sorted({g for _, c in queries for g in c})
    number = {g: n for n, g in enumerate(trigrams)}
    clauses = [(number[g], m, 1 << i, (1 << len(c)) - 1, 1 << n) for m, (n, c) in enumerate(queries) for i, g in enumerate(c)]
    table = docs.sparkSession.createDataFrame(clauses, "trigram int, clause int, member long, all long, rule long")
    met = postings(docs.filter(F.col(key).isNotNull()), trigrams, key, text).join(F.broadcast(table), "trigram")
    # the postings of a row come from one task, so they are intersected before the shuffle
    whole = met.groupBy(key, "clause", "all", "rule").agg(F.bit_or("member").alias("held")).filter("held = all")
    return whole.groupBy(key).agg(F.bit_or("rule").alias("rules"))


def running_sums(numbers, block: int = 256):
    """Sums of all elements before each, of an array of longs, plus the total at the end.

    In blocks, as an array grows by copying: n * (block + n / block ** 2) steps.
    """

    def scan(array, start):
        return F.aggregate(array, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    zero = F.lit(0).cast("long")
    starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(block))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(numbers, s, F.lit(block)), zero, lambda a, x: a + x))
    inside = F.zip_with(scan(sums, zero), starts, lambda base, s: F.when(s.isNotNull(), F.slice(scan(F.slice(numbers, s, F.lit(block)), base), F.lit(1), F.lit(block))))
    return F.flatten(F.array_compact(inside))


EMPTY = "cast(array() as array<struct<start:bigint,kind:int,finish:bigint>>)"


def with_spans(df: DataFrame, rule: Rule, n: int, wanted) -> DataFrame:
    """``df`` with the spans of rule ``n`` in its column ``t`` as ``s{n}``, where ``wanted`` holds."""
    m, g, at, lengths = f"m{n}", f"g{n}", f"a{n}", f"l{n}"

    def extract(group):
        return F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(group))

    def size(col):
        return F.coalesce(F.char_length(col), F.lit(0)).cast("long")

    df = df.withColumn(m, F.when(wanted, extract(0)))
    hit = F.size(m) > 0
    # gap 0, match 0, gap 1, match 1, ...: the sum before a match is where it starts
    both = F.flatten(F.zip_with(F.split("t", rule.pattern, -1), F.col(m), lambda gap, match: F.array(size(gap), size(match))))
    df = df.withColumns({g: F.when(hit, extract(rule.group) if rule.group else F.col(m)), lengths: F.when(hit, both)})
    df = df.withColumn(at, F.when(F.col(lengths).isNotNull(), running_sums(F.col(lengths))))

    def span(i):
        start = F.col(at)[2 * i + 1]
        return F.struct(start.alias("start"), F.lit(n).alias("kind"), (start + F.col(lengths)[2 * i + 1]).alias("finish"))

    kept = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.char_length(F.col(g)[i]) >= rule.least)
    return df.withColumn(f"s{n}", F.coalesce(F.when(F.col(at).isNotNull(), F.transform(kept, span)), F.expr(EMPTY))).drop(m, g, at, lengths)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, t, found``: every row as a struct, its text, and its spans by start and then by the order of the rules."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    listed = F.col("k").isNotNull() & in_a_pivots_list(F.col("t"), rules)
    some = saved(rows.filter(listed).select("doc", "k"), "listed").withColumn("t", F.coalesce(F.col(f"doc.`{text}`"), F.lit("")))
    some = some.join(candidates(some, rules), "k", "left").select("doc", "t", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
    others = rows.filter(~listed).select("doc", "t", F.when(F.col("k").isNull(), F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long")).alias("rules"))
    everywhere = sum(1 << n for n, rule in enumerate(rules) if not trigram_query(rule.pattern))

    def spans(out):
        out = out.withColumn("rules", F.col("rules").bitwiseOR(everywhere))
        for n, rule in enumerate(rules):
            out = with_spans(out, rule, n, F.col("rules").bitwiseAND(1 << n) != 0)
        return out.select("doc", "t", F.array_sort(F.concat(*[F.col(f"s{n}") for n in range(len(rules))])).alias("found"))

    return spans(some).unionByName(spans(others))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the counts of the base kinds, ``base_sha256`` and ``spans`` of every row."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["finish"].cast("string"))), ",")

    def count(n):
        return F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")

    found = scan(docs.select(key, text), rules, key, text).select(F.col(f"doc.{key}").alias(key), "found")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(key, *[count(n).alias(f"n_{kind}") for n, kind in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with every span in ``text`` replaced by ``mark``.

    Overlapping spans become one mark.  Texts without spans, null ones too, do not change.
    """
    found = scan(docs, rules, key, text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def replace(acc, s):
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("t"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["finish"]).alias("at"), more.alias("out"))

    done = F.aggregate("found", start, replace)
    clean = F.when(F.size("found") > 0, F.concat(done["out"], F.substring(F.col("t"), (done["at"] + 1).cast("int"), F.char_length("t")))).otherwise(F.col(f"doc.{text}"))
    return found.select(*[(clean if c == text else F.col(f"doc.{c}")).alias(c) for c in docs.columns])

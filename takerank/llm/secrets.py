r"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression with the kind of its finds. From the expression a Boolean query
over trigrams is derived: alternatives (OR) of literal strings that every match must hold, each of
which stands for the AND of its trigrams, case folded. A rule with an alternative under three
characters, or without any, has no mandatory trigrams and scans every text.

The index has a posting (trigram, row) for every trigram that a rule asks for; postings are
intersected by counting, for each row and alternative, the trigrams that are there. The rows that are
left are verified with the expressions themselves, over whole texts. Rows are known to the index by a
hash of the whole row, so repeated rows and null ids do no harm. A null text counts as empty and has no
finds, and so has an empty one; an empty table gives an empty result; other columns are carried along,
but for one named like the new column, which is replaced. Texts are taken whole, however long.

Spans are code points, end exclusive, and for each kind leftmost and not overlapping.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """pattern: what is found; group: the part that must be long enough (0: the whole), least: its length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, then well-known formats of issued tokens.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of fewer is dropped anyway, and no other run begins inside one
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE + MORE


def literals(pattern: str) -> list[str]:
    """Alternatives of which every match holds one, folded to lower case; empty if there are none.

    Understands sequences of literals, classes, groups, alternatives and quantifiers as the parser of
    the standard library reads them; the longest mandatory run of literals of each branch is taken.
    """
    parse = re._parser  # type: ignore[attr-defined]

    def runs(parsed) -> list[list[str]]:
        """Mandatory pieces of a sequence: each a list of alternative strings."""
        pieces: list[list[str]] = [[""]]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                pieces[-1] = [p + chr(arg).lower() for p in pieces[-1]]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(pieces[-1]) * len(arg) <= 16:
                pieces[-1] = [p + chr(c).lower() for p in pieces[-1] for _, c in arg]
            elif name == "SUBPATTERN":
                inner = whole(arg[-1])
                if inner and len(pieces[-1]) * len(inner) <= 64:
                    pieces[-1] = [p + q for p in pieces[-1] for q in inner]
                else:
                    pieces += [*runs(arg[-1]), [""]]
            elif name == "BRANCH":
                inner = whole([(op, arg)])
                pieces += [inner or [""], [""]]
                if inner:
                    pieces[-3:] = [[p + q for p in pieces[-3] for q in inner]]
                    pieces.append([""])
            elif name in {"MAX_REPEAT", "MIN_REPEAT"} and arg[0] >= 1:
                first = runs(arg[2])[0]
                pieces[-1] = [p + q for p in pieces[-1] for q in first]
                pieces.append([""])
            else:
                pieces.append([""])
        return pieces

    def whole(parsed) -> list[str]:
        """All strings of a sequence if they are few, else none."""
        out = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out = [p + chr(arg).lower() for p in out]
            elif name == "SUBPATTERN":
                out = [p + q for p in out for q in whole(arg[-1])]
            elif name == "BRANCH":
                branches = [whole(b) for b in arg[1]]
                out = [] if not all(branches) else [p + q for p in out for b in branches for q in b]
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                out = [p + q for p in out for q in ["", *whole(arg[2])]]
            else:
                return []
            if not out or len(out) > 64:
                return []
        return out

    pieces = runs(parse.parse(pattern))
    best = max(pieces, key=lambda alternatives: min(map(len, alternatives)))
    return sorted(set(best)) if min(map(len, best)) >= 3 else []


def trigrams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def _quoted(pattern: str) -> Column:
    return F.lit(pattern)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, kind place, kind, end) of a rule's finds, by start."""
    found = F.regexp_extract_all(text, _quoted(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    place, kind = F.lit(RULES.index(rule)), F.lit(rule.kind)
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    # the lengths of what lies between the finds and of the finds before give the starts
    pieces = F.transform(found, lambda m, i: F.struct((F.length(F.get(between, i))).alias("gap"), F.length(m).alias("size"), m.alias("m")))
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    good = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
    folded = F.aggregate(
        pieces,
        state,
        lambda s, p: F.struct(
            (s.at + p.gap + p.size).alias("at"),
            F.when(good(p.m), F.concat(s.spans, F.array(F.struct((s.at + p.gap).alias("start"), place.alias("place"), kind.alias("kind"), (s.at + p.gap + p.size).alias("end"))))).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    return F.when(F.size(found) > 0, folded).otherwise(none)


def candidates(rows: DataFrame) -> DataFrame:
    """rid and the kinds whose trigram queries a row of (rid, t) meets, from the inverted index."""
    queries = [(r.kind, n, g) for r in RULES for n, a in enumerate(literals(r.pattern)) for g in trigrams(a)]
    asked = sorted({g for _, _, g in queries})
    # one plain search a trigram costs less than an expression that tries all of them at every place
    folded = rows.select("rid", F.lower("t").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in asked]))
    postings = folded.select("rid", F.explode(held).alias("trigram"))
    # the rules are a fixed list, so this side of the join is a few hundred rows
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, n, g, sum(1 for x in queries if x[:2] == (k, n))) for k, n, g in queries], "kind string, alternative int, trigram string, need long")
    met = postings.join(F.broadcast(wanted), "trigram").groupBy("rid", "kind", "alternative").agg(F.count_distinct("trigram").alias("have"), F.max("need").alias("need")).where("have = need")
    return met.groupBy("rid").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column secrets: array of (start, place, kind, end), by start, then kind as listed in RULES."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"]).alias("row")
    rows = docs.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    keys = [f"row.`{c}`" for c, kind in docs.dtypes if c != "secrets" and "map<" not in kind and "variant" not in kind]
    rows = rows.withColumn("rid", F.xxhash64("t", *keys))
    joined = rows.join(candidates(rows.select("rid", "t")), "rid", "left")
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    # one column a rule, so that what follows does not repeat the work
    found = {f"s{i}": spans(F.col("t"), r) if not literals(r.pattern) else F.when(F.array_contains("kinds", r.kind), spans(F.col("t"), r)).otherwise(none) for i, r in enumerate(RULES)}
    joined = joined.select("row", *[c.alias(n) for n, c in found.items()])
    return joined.select("row.*", F.array_sort(F.concat(*found)).alias("secrets"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of their spans, and all spans as text."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s.place < len(BASE))

    def count(place: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s.place == place)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))

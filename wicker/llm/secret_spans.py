"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?=[PSTApsta])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: A candidate for the models; every access key and long hex run lies in one of at least 16 characters.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ["assign", "access", "hex", "markov"]


def spans(text: str, pattern: str, kind: str, keep: str) -> str:
    """SQL for the spans (start, end, kind rank) of the leftmost non-overlapping matches of pattern that pass ``keep``, a
    condition on the match m. Positions are code points; those of many matches come from sums over blocks of 128."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    match, gap = f"regexp_extract_all({text}, {p}, 0)", f"transform(split({text}, {p}, -1), g -> length(g))"
    rank = KINDS.index(kind)
    # pairs: the gap before each match and the match; the state of a block of pairs is where it begins
    pairs = f"zip_with({match}, slice({gap}, 1, size({match})), (m, g) -> named_struct('m', m, 'g', g, 'n', length(m)))"
    blocks = f"transform(sequence(0, cast((size(a) - 1) div 128 as int)), b -> slice(a, b * 128 + 1, 128))"
    sums = "transform(bs, x -> aggregate(x, 0, (s, y) -> s + y.g + y.n))"
    at = "aggregate(slice(t, 1, b), 0, (s, y) -> s + y) + aggregate(slice(x, 1, i), 0, (s, y) -> s + y.g + y.n) + z.g"
    spread = f"flatten(transform(bs, (x, b) -> transform(x, (z, i) -> named_struct('s', {at}, 'e', {at} + z.n, 'k', {rank}, 'm', z.m))))"
    bind = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    return f"transform(filter({bind('a', pairs, bind('bs', blocks, bind('t', sums, spread)))}, v -> {keep}), v -> named_struct('s', v.s, 'e', v.e, 'k', v.k, 'm', v.m))"


EMPTY = "cast(array() as array<struct<s int, e int, k int, m string>>)"


def labelled_strings(spark: SparkSession, docs: DataFrame, each: int = 4000, bound: int = 2000) -> DataFrame:
    """(text, random): ``each`` random strings of three alphabets, made from digests of numbers, and ordinary
    identifiers: the names of SQL functions, and long words of at most ``bound`` documents, single and joined in pairs."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(each).select(F.when(F.col("id") % 3 == 0, F.left(digest, F.lit(40))).when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(digest)), "=", "")).otherwise(F.upper(F.conv(F.left(digest, F.lit(15)), 16, 36))).alias("text"), F.lit(True).alias("random"))
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).distinct()  # ids alone are sorted and sent
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    word = some.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("text")).distinct()
    named = spark.sql("show functions").select(F.col("function").alias("text")).where("text rlike '^[a-z_0-9]{6,}$'")
    plain = word.union(named)
    joined = plain.select(F.concat("text", F.lit("_"), F.lower("text")).alias("text"))
    joined = joined.union(plain.select(F.concat(F.lower("text"), F.initcap("text"))))
    return random.union(plain.union(joined).select("text", F.lit(False).alias("random")))


def fit_markov(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at 128 a + b for ASCII codes, with add-smooth estimates over the 66
    characters of candidates: from counts of neighbouring characters, at most 2 x 128 x 128 numbers."""
    code = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    pair = samples.where("length(text) > 1").select("random", code.alias("c")).selectExpr("random", "explode(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> 128 * a + b)) p")
    count = {(r.random, r.p): r.n for r in pair.where("p between 0 and 16383").groupBy("random", "p").agg(F.count("*").alias("n")).collect()}
    total = {(k, a): sum(count.get((k, 128 * a + b), 0) for b in range(128)) for k in (True, False) for a in range(128)}
    log = lambda k, p: math.log((count.get((k, p), 0) + smooth) / (total[k, p // 128] + 66 * smooth))
    return [round(log(True, p) - log(False, p), 4) for p in range(128 * 128)]


def scan(docs: DataFrame, ratio: list[float], per_char: float = 0.6, least: int = 20) -> DataFrame:
    """docs with base, the spans of the fixed kinds, and spans, those and the runs that the models take for random: of at
    least ``least`` characters, with a log-likelihood ratio above ``per_char`` for each, that overlap no base span.

    Spans are structs (s, e, k, m): start and end in code points, rank of the kind, matched text, in order of start and
    kind. A null text has none. Every row of docs stays, with its columns; the scan's own columns replace any of the names
    base and spans."""
    text = "coalesce(text, '')"
    docs = docs.drop("base", "spans")
    p = lambda x: "r'" + x.replace("'", "\\x27") + "'"
    found = docs.withColumns({"__run": F.expr(f"regexp_extract_all({text}, {p(RUN)}, 0)"), "__assign": F.expr(f"regexp_extract_all({text}, {p(ASSIGN)}, 0)")})
    long = f"length(regexp_extract(v.m, {p(ASSIGN)}, 2)) >= 8"
    kinds = [
        f"if(size(__assign) = 0, {EMPTY}, {spans(text, ASSIGN, 'assign', long)})",
        f"if(not exists(__run, r -> contains(r, 'AKIA')), {EMPTY}, {spans(text, ACCESS, 'access', 'length(v.m) >= 16')})",
        f"if(not exists(__run, r -> r rlike '[0-9a-f]{{32}}'), {EMPTY}, {spans(text, HEX, 'hex', 'true')})"]
    order = "(a, b) -> case when a.s <> b.s then a.s - b.s else a.k - b.k end"
    found = found.withColumn("base", F.expr(f"array_sort(concat({', '.join(kinds)}), {order})"))
    llr = "aggregate(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> 128 * a + b), 0D, (s, q) -> s + __ratio[q])"
    score = f"transform(array(transform(split(v.m, ''), c -> ascii(c))), c -> {llr})[0] / length(v.m)"
    free = "not exists(base, b -> b.s < v.e and v.s < b.e)"
    extra = f"if(not exists(__run, r -> length(r) >= {least}), {EMPTY}, {spans(text, RUN, 'markov', f'length(v.m) >= {least} and {score} > {per_char} and {free}')})"
    model = json.dumps(ratio)
    found = found.withColumn("spans", F.expr(f"array_sort(concat(base, {extra.replace('__ratio', f'from_json({chr(39)}{model}{chr(39)}, {chr(39)}array<double>{chr(39)})')}), {order})"))
    return found.drop("__run", "__assign")


def written(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, v -> concat_ws(':', {names}[v.k], v.s, v.e)), ',')")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with <secret> for each span, and for those that begin within spans before them nothing; a text without spans stays
    as it is. The cost is in proportion to the text: its characters are parted once, and how far the spans before one
    reach comes from blocks of 128."""
    bind = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    blocks = "transform(sequence(0, cast((size(e) - 1) div 128 as int)), b -> slice(e, b * 128 + 1, 128))"
    tops = "transform(bs, x -> array_max(x))"
    reach = "greatest(0, coalesce(array_max(slice(t, 1, b)), 0), coalesce(array_max(slice(x, 1, i)), 0))"
    reaches = f"flatten(transform(bs, (x, b) -> transform(x, (z, i) -> {reach})))"  # the furthest end of all spans before
    pieces = "zip_with(v, r, (s, at) -> if(s.s >= at, concat(array_join(slice(c, at + 1, s.s - at), ''), '<secret>'), ''))"
    last = "array_join(slice(c, array_max(e) + 1, greatest(size(c) - array_max(e), 0)), '')"
    whole = bind("c", f"split({text}, '')", f"concat(array_join({pieces}, ''), {last})")
    done = bind("v", spans, bind("e", "transform(v, z -> z.e)", bind("bs", blocks, bind("t", tops, bind("r", reaches, whole)))))
    return F.expr(f"if(size({spans}) = 0, {text}, {done})")

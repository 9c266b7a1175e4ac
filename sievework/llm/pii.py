"""Personal data by patterns, and by contextual extraction bootstrapped from what they find.

Fixed patterns give the base spans. These are seeds: the words around them are lexical patterns. A graph of
such patterns and of the identifier-like tokens they surround is scored in rounds: a pattern is as good as
the tokens it extracts, a token as good as its patterns together. Tokens that aren't seeds but stand in
high-confidence patterns become spans of kind ``other``. Only DataFrame and SQL functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, sized, unused

#: Kinds in order, and their patterns. Possessive where nothing could be given back, which keeps
#: long runs linear and off the stack; a local part begins at the start of its run or where a match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Candidates: a run of tokens of digits and their punctuation, or a token with a digit or an at sign in it; and the
#: punctuation around one that isn't part of it.
TOKEN = r"(?<!\S)(?:[+(]*[0-9][0-9().+/\-]*(?:\x20[(]?[0-9][0-9().+/\-]*)++(?=[\s.,;:!?]|$)|[^\s0-9@]*+[0-9@]\S*+)"
OPEN, CLOSE = "\"'([{<", ".,;:!?\"')]}>"
#: What a candidate that isn't a seed must have to be an identifier: characters, and digits or an at sign.
LEAST_LENGTH, LEAST_DIGITS = 5, 2
#: Weight of doubt in a pattern's confidence, in tokens; rounds of scoring; scores from which patterns and tokens count.
DOUBT, ROUNDS, GOOD_PATTERN, GOOD_TOKEN = 3.0, 3, 0.5, 0.8
SPANS = "array<struct<s:int,e:int,m:string>>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches that one pass of ``matches`` appends to each other.
BLOCK = 256


def pieces(text: str, pattern: str) -> str:
    """SQL for the text before each match of a pattern, and what is left at the end, with the match (null at the end)."""
    p = quoted(pattern)
    return f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"


def placed(z: str) -> str:
    """SQL for the matches among ``pieces`` as structs of start, end (code points) and match.

    The pieces' lengths give the places: within blocks first, then the blocks' own places are added, since an
    array that grows by one is copied each time.
    """
    block = (
        f"aggregate(slice({z}, b + 1, {BLOCK}), named_struct('at', 0, 'out', cast(array() as {SPANS})), "
        "(a, x) -> named_struct('at', a.at + length(x.`0`) + coalesce(length(x.`1`), 0), 'out', if(x.`1` is null, a.out, concat(a.out, "
        "array(named_struct('s', a.at + length(x.`0`), 'e', a.at + length(x.`0`) + length(x.`1`), 'm', x.`1`))))))"
    )
    blocks = f"transform(sequence(0, size({z}) - 1, {BLOCK}), b -> {block})"
    places = "aggregate(y, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    moved = f"flatten(zip_with(y, {places}, (x, at) -> transform(x.out, m -> named_struct('s', m.s + at, 'e', m.e + at, 'm', m.m))))"
    return f"transform(array({blocks}), y -> {moved})[0]"


def matches(text: str, pattern: str) -> str:
    """SQL for the leftmost matches of a pattern that don't overlap, as structs of start, end (code points) and match."""
    return f"transform(array({pieces(text, pattern)}), z -> {placed('z')})[0]"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def holds(kind: str) -> str:
    """SQL for whether match ``x.m`` passes its kind's test."""
    d = digits("x.m")
    if kind == "ip":
        return "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(nullif(ltrim('0', p), '') as int), 0) <= 255)"
    if kind == "card":
        doubled = "(cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0))"
        summed = f"aggregate(transform(filter(split(reverse({d}), ''), c -> c <> ''), (c, i) -> if(i % 2 = 0, cast(c as int), {doubled})), 0, (a, v) -> a + v)"
        return f"if(length({d}) between 13 and 19, {summed} % 10 = 0, false)"
    if kind == "phone":
        return f"length({d}) between 9 and 15"
    return "true"


def base_spans(text: str) -> Column:
    """array<struct<kind, s, e>> of the fixed patterns' spans in column ``text``, by kind as listed, then start."""
    parts = []
    for kind, pattern in PATTERNS.items():
        found = f"filter({matches(text, pattern)}, x -> {holds(kind)})"
        made = f"transform({found}, x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e))"
        parts.append(f"case when {text} rlike {quoted(HINTS[kind])} then {made} else cast(array() as array<struct<kind:string,s:int,e:int>>) end")
    return F.expr(f"concat({', '.join(parts)})")


def bootstrapped(scratch: Scratch, found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, score of the candidates that aren't seeds and that high-confidence patterns reach, from candidates (instance, seed, patterns).

    An instance that is a seed anywhere is one. Equal scores need no order: each is a sum over the whole graph.
    """
    links = found.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = scratch.keep(links.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    tokens = scratch.keep(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("score")), "tokens")
    for _ in range(rounds):
        scored = edges.select("pattern", "instance").join(tokens, "instance")
        trust = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(DOUBT))).alias("confidence"), F.count_if("seed").alias("seeds"))
        good = scratch.keep(trust.where((F.col("confidence") >= GOOD_PATTERN) & (F.col("seeds") >= 2)).select("pattern", "confidence"), "patterns")
        reached = edges.join(sized(good), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("reached"))
        old = tokens
        tokens = scratch.keep(old.drop("score").join(reached, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score")), "tokens")
        scratch.drop(old, good)
    digits_of = F.length(F.regexp_replace("instance", "[^0-9]", ""))
    shaped = (F.length("instance") >= LEAST_LENGTH) & ((digits_of >= LEAST_DIGITS) | F.contains("instance", F.lit("@")))
    return tokens.where(~F.col("seed") & (F.col("score") >= GOOD_TOKEN) & shaped).select("instance", "score")


def learnt(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """id, h, other (spans that patterns add) of those ``rows`` (id, h, text) that have any, once for equal rows. Texts don't move: only candidates do."""
    some = rows.where(F.col("text").rlike("[0-9@]")).select("id", "h", "text", base_spans("text").alias("base"))
    # the outer form: for the other Spark infers a filter on the array, and so finds the candidates once more for each of its conditions
    each = with_candidates(some).select("id", "h", F.explode_outer("tokens").alias("t"))
    found = scratch.keep(each.where("t is not null").select("id", "h", "t.*"), "candidates")
    extra = scratch.keep(bootstrapped(scratch, found), "extra")
    hits = found.where(~F.col("seed")).join(sized(extra), "instance")
    return scratch.keep(hits.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct(F.lit("other").alias("kind"), "s", "e"))).alias("other")), "other")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two columns more, ``SPANS_COLS``: base and other spans, arrays of (kind, s, e), of every row, repeated rows too.

    A null text is an empty one and has no spans. A null id is an id like others; of one id each text has its own spans. Very
    long texts are read whole. No rows give none, and a table without seeds has no other spans.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    base, other, h = unused(docs.columns, "base", "other", "h")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = learnt(scratch, docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")))
    found = found.toDF(i := unused(docs.columns, "i")[0], h, other)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h))
    rows = docs.join(sized(found), same, "left").drop(i, h)
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")
    plain = F.when(text.rlike("[0-9@]"), base_spans(f"`{text_col}`")).otherwise(none)
    return rows.withColumn(other, F.coalesce(F.col(other), none)).withColumn(base, plain)


def with_candidates(rows: DataFrame) -> DataFrame:
    """id, h and tokens: the candidates as an array, for rows of (id, h, base, text).

    A candidate's patterns are the word before, the two words before, the word after and both neighbours; where
    another candidate stands next to it, that one with its digits masked is the word.
    """
    # what a lambda uses again and again is bound outside of it, or it would be computed for each candidate
    masked = "regexp_replace({}, '[0-9]+', '#')"
    before, after = (f"translate({x}, '\\t\\n\\r\\u000b\\u000c', '     ')" for x in ("w.z[i].`0`", "w.z[i + 1].`0`"))
    cut = f"""
        transform(w.found, (t, i) -> named_struct(
            's', t.s + length(t.m) - length(ltrim({quoted(OPEN)}, t.m)), 'instance', rtrim({quoted(CLOSE)}, ltrim({quoted(OPEN)}, t.m)),
            'before', lower(coalesce(nullif(substring_index(rtrim({before}), ' ', -1), ''), if(i > 0, {masked.format("w.found[i - 1].m")}, ''))),
            'two', lower(substring_index(rtrim({before}), ' ', -2)),
            'after', lower(coalesce(nullif(substring_index(ltrim({after}), ' ', 1), ''), if(i + 1 < size(w.found), {masked.format("w.found[i + 1].m")}, '')))))
    """
    made = f"""
        transform(filter({cut}, t -> t.instance <> ''), t -> named_struct('s', t.s, 'e', t.s + length(t.instance), 'instance', t.instance,
            'seed', exists(w.base, b -> b.s < t.s + length(t.instance) and b.e > t.s),
            'patterns', filter(array(if(t.before <> '', concat('left ', t.before), null), if(trim(t.two) like '% %', concat('left ', t.two), null), if(t.after <> '', concat('right ', t.after), null),
                if(t.before <> '' and t.after <> '', concat('around ', t.before, ' _ ', t.after), null)), p -> p is not null)))
    """
    bound = f"transform(array({pieces('text', TOKEN)}), z -> transform(array(named_struct('found', {placed('z')}, 'z', z, 'base', base)), w -> {made})[0])[0]"
    return rows.select("id", "h", F.expr(bound).alias("tokens"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone (base spans), n_other, base_sha256, spans (all) of every row.

    Nulls, repeated rows and ids, very long texts and empty tables: see ``spans``. Extra columns are left out, whatever their names.
    """
    rows = spans(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in PATTERNS]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "other")).alias("spans"), F.size("other").cast("long").alias("n_other"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans as one, of the first's kind.

    Other columns stay as they are, whatever their names. A null text stays null. Texts are cut where they are
    read, in one pass, while the rows with added spans fit a broadcast.
    """
    rows = spans(docs, id_col, text_col)
    base, other = rows.columns[-1], rows.columns[-2]
    by_start = F.array_sort(F.transform(F.concat(F.col(base), F.col(other)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    spans_col = unused(rows.columns, "spans")[0]
    t = f"`{text_col}`"
    cut = F.expr(
        f"aggregate(`{spans_col}`, named_struct('at', 0, 'out', ''), (a, x) -> if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out), "
        f"named_struct('at', x.e, 'out', concat(a.out, substring({t}, a.at + 1, x.s - a.at), '[', upper(x.kind), ']'))), a -> concat(a.out, substring({t}, a.at + 1)))"
    )
    done = F.when(F.size(spans_col) > 0, cut).otherwise(F.col(t)).alias(text_col)
    return rows.withColumn(spans_col, by_start).select(*(done if c == text_col else F.col(f"`{c}`") for c in docs.columns))

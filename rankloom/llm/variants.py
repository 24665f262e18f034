"""Spelling variants: words one edit apart, by asymmetric q-chunks.

Of a near pair the shorter word (of equal lengths, the smaller) gives two
disjoint chunks, its first and last q code points with q half its length, and
the other word all its positional grams of that q. An edit touches at most one
chunk, so the other one is a gram of the longer word, moved by at most one
place. The join key holds the chunk's length class, number and place, so grams
that no chunk of that length can meet are left out before the shuffle. A pair
that both chunks find counts where the first chunk finds it.

A chunk may belong to many words (a common beginning or end). Words of a chunk
shared by more than ``HOT`` words are not paired: what is left of them beside
the chunk must still be one edit apart, so they join on the chunk and the rest
with one place left out. All that meets there is near, so the work is bounded
by the result, and nothing is capped.

All counts cover the whole corpus. Forms are followed to their roots by pointer
doubling; a form has at least twice its word's count, so chains are at most
the logarithm of the largest count long.

Defined cases: null and empty texts have no words; a null doc_id enters the
checksum as nothing (``:word``); repeated rows count each; ties of the form go
to the smallest word in code-point order; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import UPPER, ascii_lower, maybe_broadcast, settle, stored, table

RUN = r"([A-Za-zÀ-ÿ]{5,})"
SHORTEST, LEAST, DAMAGE = 5, 3, 97
#: A chunk that more words share is split by the rest of the word.
HOT = 64


def words(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the corpus: runs, some with one code point deleted, that occur often enough."""
    # A run has its result's length or one more, so runs shorter than that cannot matter.
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN.replace("5", str(shortest))), 1)).alias("run")
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    found = found.select(ascii_lower(F.col("run")).alias("w"), F.crc32(F.concat("id", F.lit(":"), ascii_lower(F.col("run"))).cast("binary")).alias("h"))
    at = F.col("h") % F.length("w")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("w"))
    return found.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _sub(word: str, start: Column, length: Column) -> Column:
    """Code points of ``word`` from ``start``, counted from 0."""
    return F.substring(F.col(word), (start + 1).cast("int"), length.cast("int"))


def _chunks(vocabulary: DataFrame) -> DataFrame:
    """(len, k, at, gram, word, rest): both chunks of every word, at each place that a partner may have them.

    ``len`` is the chunked word's length; ``grow`` is 1 where the partner is longer by one.
    """
    n = F.length("word")
    q = F.floor(n / 2).cast("int")
    both = F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.lit(0).alias("start"), _sub("word", F.lit(0), q).alias("gram"), _sub("word", q, n - q).alias("rest")),
        F.struct(F.lit(2).alias("k"), (n - q).alias("start"), _sub("word", n - q, q).alias("gram"), _sub("word", F.lit(0), n - q).alias("rest")),
    )).alias("c")
    return vocabulary.select("word", n.alias("len"), both).select("word", "len", "c.*")


def _grams(vocabulary: DataFrame) -> DataFrame:
    """(len, k, grow, gram, word, rest): the positional grams of every word, as partner of words as long or one shorter.

    Of all grams, those at a place where a chunk of that length, moved by at
    most one, can lie: chunk 1 stays at 0 and chunk 2 ends where the word ends
    (moved by one in the longer word) in every pair with one edit outside it.
    """
    as_partner = vocabulary.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("grow")).withColumn("len", F.length("word") - F.col("grow"))
    as_partner = as_partner.withColumn("q", F.floor(F.col("len") / 2).cast("int"))
    grams = as_partner.select("word", "len", "grow", "q", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("word") - F.col("q")), lambda i: _sub("word", i, F.col("q")))).alias("place", "gram"))
    last = F.length("word") - F.col("q")
    k = F.when(F.col("place") == 0, 1).when(F.col("place") == last, 2)
    rest = F.when(F.col("place") == 0, _sub("word", F.col("q"), last)).otherwise(_sub("word", F.lit(0), last))
    return grams.select("word", "len", "grow", k.alias("k"), "gram", rest.alias("rest")).filter("k is not null")


def _one_edit(x: Column, y: Column) -> Column:
    """Whether two words, equal or y longer by one, are exactly one edit apart."""
    return F.levenshtein(x, y, 1) == 1


def near_pairs(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): every pair of words one insertion, deletion or replacement apart, once."""
    chunks, grams = _chunks(vocabulary), _grams(vocabulary)
    key = ["len", "k", "gram"]
    busy = settle(grams.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot).select(*key))
    flag = maybe_broadcast(busy.withColumn("busy", F.lit(True)), 64)
    chunks = chunks.join(flag, key, "left")
    grams = grams.join(flag, key, "left")
    x = chunks.select(*key, "busy", F.col("word").alias("a"), F.col("rest").alias("rest_a"))
    y = grams.select(*key, "busy", "grow", F.col("word").alias("b"), F.col("rest").alias("rest_b"))
    # Both words of a pair of equal lengths give chunks, so only the smaller one's count; what the first chunk finds, the second does not repeat.
    ordered = (F.col("grow") == 1) | (F.col("a") < F.col("b"))
    q = F.floor(F.col("len") / 2).cast("int")
    fresh = (F.col("k") == 1) | (_sub("a", F.lit(0), q) != _sub("b", F.lit(0), q))

    calm = x.filter("busy is null").drop("busy").join(y.filter("busy is null").drop("busy"), key)
    calm = calm.filter(ordered & fresh & _one_edit(F.col("a"), F.col("b"))).select("a", "b")

    xs, ys = x.filter("busy"), y.filter("busy")
    places = lambda rest: F.posexplode(F.transform(F.sequence(F.lit(0), F.length(rest) - 1), lambda i: F.concat(_sub(rest, F.lit(0), i), _sub(rest, i + 1, F.length(rest))))).alias("i", "left")
    # Replaced: the rests agree without place i. Inserted: the longer rest without one place is the shorter.
    same = xs.select(*key, "a", places("rest_a")).join(ys.filter("grow = 0").select(*key, "b", "grow", places("rest_b")), [*key, "i", "left"])
    same = same.filter(ordered & fresh).select("a", "b")
    longer = ys.filter("grow = 1").select(*key, "b", "grow", places("rest_b")).select(*key, "b", "grow", "left").distinct()
    longer = xs.select(*key, "a", F.col("rest_a").alias("left")).join(longer, [*key, "left"]).filter(fresh).select("a", "b")
    return calm.unionByName(same).unionByName(longer)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form (word, form): the end of its chain, by pointer doubling."""
    at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = at.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        ahead = settle(ahead)
        if not ahead.filter("moved").limit(1).count():
            return ahead.select("word", "root")
        at = ahead.select("word", "root")


def variants(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damage: int = DAMAGE, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    vocabulary = stored(words(documents, shortest, least, damage), "words")
    pairs = near_pairs(vocabulary.select("word"), hot)
    other = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("m"))
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(other, "b")
    # Largest count, then the smallest word: the order of (-count, word).
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("top"))
    out = vocabulary.join(best, "word", "left")
    has = -F.col("top.m") >= 2 * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("top.b")).alias("form"), F.when(has, -F.col("top.m")).alias("form_n")), "near")
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The checksum's table entries follow the bit rule; words are matched through all strings with one place left out.
SQL = f"""
with recursive bits as (
  select range as b, 0 as i, range::ubigint as c from range(256)
  union all
  select b, i + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where i < 8),
crc as materialized (select list(c order by b) as entry from bits where i = 8),
runs as (
  select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')), '{UPPER}', '{UPPER.lower()}') as w
  from documents),
distinct_runs as materialized (
  select id, w, count(*) as times, id || ':' || w as s from runs group by all),
summed as materialized (
  select w, times, xor(list_reduce(list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::int, 2))::ubigint),
    lambda a, x: xor(a >> 8, entry[(xor(a & 255, x) + 1)::int]), 4294967295::ubigint), 4294967295::ubigint) as h
  from distinct_runs, crc),
vocabulary as materialized (
  select word, sum(times)::bigint as n from (
    select case when h % {DAMAGE} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w) + 2)::int) else w end as word, times from summed)
  where length(word) >= {SHORTEST} group by word having sum(times) >= {LEAST}),
less as materialized (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1))::int as i from vocabulary)),
pairs as materialized (
  select distinct * from (
    select a.word, b.word as other, b.n as m from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union all select a.word, b.word, b.n from less a join vocabulary b on a.rest = b.word
    union all select b.word, a.word, a.n from less a join vocabulary b on a.rest = b.word)),
best as materialized (
  select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, encode(other))) as top from pairs group by word),
near as materialized (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then top end as form, case when m >= 2 * n then m end as form_n
  from vocabulary v left join best using (word)),
chain as (
  select word, word as here, 0 as depth from near
  union all
  select c.word, n.form, depth + 1 from chain c join near n on n.word = c.here where n.form is not null)
select near.word, form, root, n, n_near, form_n from near join (select word, arg_max(here, depth) as root from chain group by word) using (word)
"""

"""Importance resampling towards a target distribution, by hashed word runs that DuckDB counts in each task.

Method. A task hands its texts, batch by batch, to a DuckDB of its own in memory: SQL
unnests the words, makes the runs by a window's ``lead``, hashes each distinct run by
a registered zlib CRC function and counts buckets for each document and for the whole
partition. Spark spills both to Parquet in the shared folder, adds up the partitions'
counts (at most BUCKETS numbers a task, and BUCKETS in all), turns them into a gain
for each bucket and scores the spilled documents in the JVM. Noise of a Gumbel
distribution, derived from the id, makes the highest scores a sample in proportion to
the weights, without replacement. Ranks come from one sort by ranges (see
``common.positions``); no task holds more than its range.

Bounds. A text of more than CHUNK characters is cut between words, with as many words
of overlap as the longest run needs; a run counts where its last word is new, so the
counts are those of the whole text. Only a single word may be longer than that.

Semantics. A null text has no words: no features, weight 0. Rows that repeat are
documents each by itself; among rows of one id and score the order is that of the
files. A null id hashes as the empty text and comes after all ids in ties. An empty
target leaves every bucket to the corpus' own counts; an empty table gives an empty
result. Columns that clash with the new ones get those with underscores before them.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, pieces, positions, small_batches, table, utf8

BUCKETS = 10_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of text that DuckDB counts at a time.
PIECE = 2 << 20
#: Characters of a text that DuckDB takes as one row.
CHUNK = 1 << 20
#: ASCII bytes that are no letter or digit become spaces, capitals small letters; all other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(column: pa.Array) -> pa.Array:
    """The texts with FOLD applied to their bytes, in one go; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    plain = data.to_pybytes().translate(FOLD) if data else b""
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, offsets, pa.py_buffer(plain)], 0, column.offset)


def chunks_of(text: str, overlap: int, most: int = CHUNK):
    """(words repeated from the chunk before, chunk) of a folded text, cut at spaces."""
    begin, tail = 0, []
    while begin < len(text):
        end = len(text) if len(text) - begin <= most else text.rfind(" ", begin, begin + most)
        if end < begin + 1:
            end = text.find(" ", begin + most)
            end = len(text) if end < 0 else end
        body = text[begin:end]
        yield len(tail), " ".join([*tail, body])
        if overlap:
            tail = (tail + body.split())[-overlap:]
        begin = end


def run_sql(shortest: int, longest: int) -> str:
    """Rows (doc, gram) of the table ``piece`` (doc, part, skip, body): every run of those many words."""
    if longest == 1:
        return "SELECT doc, gram FROM (SELECT doc, unnest(string_split(body, ' ')) AS gram FROM piece) WHERE gram <> ''"
    words = """
        WITH split AS (SELECT doc, part, skip, list_filter(string_split(body, ' '), lambda w: w <> '') AS list FROM piece),
        words AS (SELECT doc, part, skip, unnest(list) AS word, unnest(range(1, len(list) + 1)) AS place FROM split)
    """
    runs = []
    for n in range(shortest, longest + 1):
        following = "".join(f", lead(word, {k}) OVER w" for k in range(1, n))
        runs.append(f"SELECT doc, concat_ws(' ', word{following}) AS gram FROM words WINDOW w AS (PARTITION BY part ORDER BY place) QUALIFY place + {n - 1} > skip AND lead(word, {n - 1}) OVER w IS NOT NULL")
    return words + " UNION ALL ".join(runs)


def counter(shortest: int, longest: int, buckets: int):
    """A DuckDB connection that counts: ``piece`` registered, COUNT run, then tables ``found`` and ``totals``."""
    import duckdb

    held = duckdb.connect(config={"threads": "1", "temp_directory": ""})
    crc = lambda grams: pa.array([zlib.crc32(utf8(g)) for g in grams.to_pylist()], pa.uint32())
    held.create_function("zlib_crc32", crc, ["VARCHAR"], "UINTEGER", type="arrow")
    held.execute("CREATE TABLE totals (bucket INTEGER, n BIGINT)")
    count = f"""
        CREATE OR REPLACE TEMP TABLE found AS
        WITH counted AS (SELECT doc, gram, count(*) AS n FROM ({run_sql(shortest, longest)}) GROUP BY ALL),
        named AS (SELECT gram, (zlib_crc32(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM counted))
        SELECT doc, bucket, sum(n)::BIGINT AS n FROM counted JOIN named USING (gram) GROUP BY ALL
    """
    return held, count


def spill(docs: DataFrame, scratch: Scratch, name: str, text: str = "text", carry=None, lengths=(1, 1), buckets: int = BUCKETS) -> tuple[DataFrame, dict[str, str]]:
    """Writes a row for each document (``carry`` columns, n_words, n_features, buckets, counts) and one for each task's totals.

    A task's row has its totals in all_buckets and all_counts, which are null elsewhere:
    who wants only them reads only those columns. Returns the written table and its names.
    """
    carry = list(docs.columns if carry is None else carry)
    fields = {"n_words": T.LongType(), "n_features": T.LongType(), "buckets": T.ArrayType(T.IntegerType()), "counts": T.ArrayType(T.LongType()), "all_buckets": T.ArrayType(T.IntegerType()), "all_counts": T.ArrayType(T.LongType())}
    names, taken = {}, list(carry)
    for c in fields:
        names[c] = free_name(taken, c)
        taken.append(names[c])
    body = free_name(taken, "body")
    source = docs.select(*carry, F.col(text).alias(body))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in source.schema.fields[: len(carry)]), *(T.StructField(names[c], t) for c, t in fields.items())])
    shortest, longest = lengths
    arrow = {"n_words": pa.int64(), "n_features": pa.int64(), "buckets": pa.list_(pa.int32()), "counts": pa.list_(pa.int64()), "all_buckets": pa.list_(pa.int32()), "all_counts": pa.list_(pa.int64())}

    def run(batches):
        held, count = counter(shortest, longest, buckets)
        kinds = None
        for batch in pieces(batches, body, PIECE):
            kinds = [c.type for c in batch.columns[: len(carry)]]
            texts = folded(batch.column(len(carry)))
            rows = []
            for at, words in enumerate(texts.to_pylist()):
                if len(words) <= CHUNK:
                    rows.append((at, 0, words))
                else:
                    rows.extend((at, skip, part) for skip, part in chunks_of(words, longest - 1))
            docs_, skips, bodies = zip(*rows, strict=True)
            held.register("piece", pa.table({"doc": pa.array(docs_, pa.int32()), "part": pa.array(range(len(rows)), pa.int32()), "skip": pa.array(skips, pa.int32()), "body": pa.array(bodies, pa.large_string())}))
            held.execute(count)
            held.execute("INSERT INTO totals SELECT bucket, sum(n) FROM found GROUP BY bucket")
            answer = held.sql("SELECT doc, sum(n)::BIGINT AS n, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM found GROUP BY doc").to_arrow_table()
            held.unregister("piece")
            size = len(batch)
            if longest == 1 and shortest == 1:
                n_words = None
            else:
                n_words = [len(words.split()) for words in texts.to_pylist()]
            features, lists, numbers = [0] * size, [[]] * size, [[]] * size
            for doc, n, own, times in zip(*(answer.column(c).to_pylist() for c in ("doc", "n", "buckets", "counts")), strict=True):
                features[doc], lists[doc], numbers[doc] = n, own, times
            columns = {"n_words": n_words or features, "n_features": features, "buckets": lists, "counts": numbers, "all_buckets": [None] * size, "all_counts": [None] * size}
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(v, arrow[c]) for c, v in columns.items())], names=schema.names)
        if kinds is not None:
            answer = held.execute("SELECT bucket, sum(n)::BIGINT AS n FROM totals GROUP BY bucket ORDER BY bucket").fetchall()
            columns = {"n_words": [None], "n_features": [None], "buckets": [None], "counts": [None], "all_buckets": [[b for b, _ in answer]], "all_counts": [[n for _, n in answer]]}
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *(pa.array(v, arrow[c]) for c, v in columns.items())], names=schema.names)
        held.close()

    return scratch.keep(source.mapInArrow(run, schema), name), names


def totals(spilled: DataFrame, names: dict[str, str]) -> dict[int, int]:
    """Bucket -> count over the whole table: at most as many numbers as there are buckets."""
    parts = spilled.select(F.col(names["all_buckets"]).alias("b"), F.col(names["all_counts"]).alias("c")).filter("b IS NOT NULL")
    each = parts.select(F.explode(F.arrays_zip("b", "c")).alias("x"))
    return {r["b"]: r["n"] for r in each.groupBy(F.col("x.b").alias("b")).agg(F.sum("x.c").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """For each bucket a thousand times the log ratio of its smoothed shares in target and corpus, floors going down."""
    every, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * every / (float(corpus.get(b, 0) + 1) * wanted))) for b in range(buckets)]


def noise(doc_id, seed: str = SEED):
    """A thousand times a Gumbel number drawn by the id's hash, floors going down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(share)))


def scored(spilled: DataFrame, names: dict[str, str], gain: list[int], doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The spilled documents with weight and score (names by free_name) instead of their buckets."""
    weight, score = free_name(spilled.columns, "weight"), free_name(spilled.columns, "score")
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with(names["buckets"], names["counts"], lambda b, n: F.get(known, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    out = spilled.filter(F.col(names["n_features"]).isNotNull()).withColumn(weight, total).withColumn(score, F.col(weight) + noise(F.col(doc_id), seed))
    names |= {"weight": weight, "score": score}
    return out.drop(*(names[c] for c in ("buckets", "counts", "all_buckets", "all_counts")))


def importance(docs: DataFrame, target: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", carry=None, lengths=(1, 1), buckets: int = BUCKETS, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``carry`` columns of the documents (all, if not given) with n_words, n_features, weight and score; and those names."""
    spilled, names = spill(docs, scratch, "documents", text, carry, lengths, buckets)
    wanted, own = spill(target, scratch, "target", text, [], lengths, buckets)
    gain = gains(totals(spilled, names), totals(wanted, own), buckets)
    scratch.drop("target")
    return scored(spilled, names, gain, doc_id, seed), names


def order_of(names: dict[str, str], doc_id: str = "doc_id") -> list:
    return [F.col(names["score"]).desc(), F.col(doc_id).asc_nulls_last(), F.col(names["n_features"]).asc()]


def drawn_of(found: DataFrame, names: dict[str, str], percent: int, least_words: int) -> tuple[DataFrame, int]:
    """The documents that may be drawn, and how many are."""
    able = found.filter(F.col(names["n_words"]) >= least_words)
    return able, able.count() * percent // 100


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id", **more) -> tuple[DataFrame, dict[str, str]]:
    """``importance`` with the drawn documents' rank (1, 2, 3 ... by score, ties to the smaller id), null for the rest."""
    scratch = Scratch(docs.sparkSession, "resampling")
    found, names = importance(docs, target, scratch, text, doc_id, **more)
    able, draw = drawn_of(found, names, percent, least_words)
    names["rank"] = free_name(found.columns, "rank")
    placed, place = positions(able, order_of(names, doc_id), scratch, "ranks")
    rank = F.when(F.col(place) < draw, F.col(place) + 1).cast("long")
    rest = found.filter(F.col(names["n_words"]) < least_words).withColumn(names["rank"], F.lit(None).cast("long"))
    return placed.withColumn(names["rank"], rank).drop(place).unionByName(rest), names


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id", **more) -> DataFrame:
    """The drawn documents, whole and with their own columns: ``percent`` of those of at least ``least_words`` words.

    Only ids, scores and the files' own row numbers are sorted; the texts stay where
    they are and are compared with the last drawn row.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    found, names = importance(docs, target, scratch, text, doc_id, carry=docs.columns, **more)
    line = free_name(found.columns, "line")
    found = scratch.keep(found.withColumn(line, F.monotonically_increasing_id()), "scored")
    able, draw = drawn_of(found, names, percent, least_words)
    keys = able.select(F.col(names["score"]).alias("score"), F.col(doc_id).alias("id"), F.col(names["n_features"]).alias("n"), F.col(line).alias("line"))
    placed, place = positions(keys, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n").asc(), F.col("line").asc()], scratch, "ranks")
    last = placed.filter(F.col(place) == draw - 1).first()
    if last is None:
        return docs.limit(0)
    score, key, n, at = (F.lit(last[c]) for c in ("score", "id", "n", "line"))
    own, ident, features, number = (F.col(c) for c in (names["score"], doc_id, names["n_features"], line))
    tie = (features < n) | ((features == n) & (number <= at))
    before = F.lit(False) if last["id"] is None else ident < key
    among = F.coalesce(F.when(ident.eqNullSafe(key), tie).otherwise(before if last["id"] is not None else ident.isNotNull()), F.lit(False))
    return able.filter((own > score) | ((own == score) & among)).select(*docs.columns)


def op11_resampling(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = ranked(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", *(F.col(names[c]).alias(c) for c in ("n_features", "weight", "score", "rank")))


#: The same in DuckDB; the CRC of a word goes byte by byte through a table that eight halvings make.
SQL = r"""
WITH bits AS (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM range(256) t(i)),
crcs AS (SELECT list(crc ORDER BY i) AS entry FROM bits),
folded AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS line, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
  UNION ALL
  SELECT 'b', NULL, -row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, line, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM folded),
counted AS (SELECT side, line, word, count(*) AS n FROM words GROUP BY ALL),
spelt AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM words)),
named AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, entry[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM spelt, crcs),
held AS (SELECT side, line, bucket, n FROM counted JOIN named USING (word)),
corpus AS (SELECT bucket, sum(n) AS s FROM held WHERE side = 'd' GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM held WHERE side = 'b' GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (every + 10000)::DOUBLE / ((s + 1)::DOUBLE * (wanted + 10000)::DOUBLE)))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket), (SELECT coalesce(sum(s), 0) AS every FROM corpus), (SELECT coalesce(sum(t), 0) AS wanted FROM target)),
weighed AS (SELECT line, sum(n) AS n_features, sum(n * gain) AS weight FROM held JOIN gain USING (bucket) WHERE side = 'd' GROUP BY line),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM folded LEFT JOIN weighed USING (line) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""

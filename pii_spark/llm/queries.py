"""Registered queries of the operators, and the DuckDB statements that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pii_spark.functions.offsets import bind
from pii_spark.llm import bpe, images, language, licenses, lines, merkle, minhash, packing, periods, quotes, sharding, substring, vectors
from pii_spark.llm.common import partitions, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeats(docs, length=35, single_spaces=True)
    return out.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op2_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = minhash.near_duplicates(docs, shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(language.training_lines(docs, ~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.9)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_path("byte_bpe_50k.json"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = lines.remove_spread_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH split AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
spread AS (
  SELECT trim(line) AS line FROM split WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, '')) >= 8),
marked AS (
  SELECT s.doc_id, s.pos, s.line, trim(s.line) <> '' AS counts, p.line IS NOT NULL AS hit
  FROM split s LEFT JOIN spread p ON trim(s.line) = p.line),
totals AS (
  SELECT doc_id, count(*) FILTER (counts) AS n, count(*) FILTER (hit) AS hits,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE n END AS INTEGER) AS n_lines,
       CAST(CASE WHEN hits > 0 AND hits <= n * 0.5 THEN hits ELSE 0 END AS INTEGER) AS n_removed,
       sha256(CASE WHEN hits > 0 AND hits <= n * 0.5 THEN kept ELSE d.text END) AS kept_sha256
FROM documents d JOIN totals t ON d.doc_id = t.doc_id
"""


def _quoting(messages: DataFrame) -> DataFrame:
    """The messages of the table as mail would have them: each below the two before it, quoted."""
    base = messages.select("conv_id", "turn", "role", "text")

    def earlier(steps: int) -> DataFrame:
        marked = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("> " * steps), x))
        return base.select("conv_id", (F.col("turn") + steps).alias("turn"), F.array_join(marked, "\n").alias(f"q{steps}"))

    joined = base.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", "q2", "q1", "text").alias("text"))


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(_quoting(table(spark, sf_dir, "conversations")))
    return out.select(
        "conv_id", "turn", "role", F.sha2("body", 256).alias("body_sha256"), "n_quotes", "n_linked", "reply_to", "thread", "depth"
    )


OP7_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id, turn, role, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM conversations),
plain AS (
  SELECT conv_id, turn, pos, trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS plain FROM own),
runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM plain WHERE plain <> ''),
passages AS (
  SELECT conv_id, turn, run, string_agg(plain, ' ' ORDER BY pos) AS whole, count(*) AS n FROM runs GROUP BY ALL),
pieces AS (
  SELECT conv_id, turn, run, 0 AS part, whole AS plain FROM passages
  UNION ALL
  SELECT r.conv_id, r.turn, r.run, 1, r.plain FROM runs r JOIN passages p USING (conv_id, turn, run) WHERE p.n > 1),
origins AS (SELECT conv_id, plain, min(turn) AS origin FROM pieces GROUP BY ALL),
quoted AS (
  SELECT p.conv_id, p.turn + s.steps AS turn, s.steps AS level, p.run, p.part, p.plain
  FROM pieces p, (VALUES (1), (2)) s(steps)),
found AS (
  SELECT q.*, o.origin FROM quoted q JOIN origins o ON q.conv_id = o.conv_id AND q.plain = o.plain AND o.origin < q.turn),
links AS (
  SELECT conv_id, turn, count(DISTINCT (level, run)) AS n_linked,
         arg_min(origin, struct_pack(a := level, b := part, c := -origin)) AS reply_to
  FROM found GROUP BY ALL),
up AS (
  SELECT m.conv_id, m.turn, m.turn AS thread, CAST(0 AS BIGINT) AS depth FROM conversations m
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.conv_id = m.conv_id AND l.turn = m.turn)
  UNION ALL
  SELECT l.conv_id, l.turn, up.thread, up.depth + 1 FROM links l JOIN up ON l.conv_id = up.conv_id AND l.reply_to = up.turn),
counts AS (SELECT conv_id, turn, count(*) AS n FROM passages GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, sha256(regexp_replace(m.text, '^\n+|\n+$', '', 'g')) AS body_sha256,
       CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS INTEGER) AS n_quotes,
       CAST(coalesce(l.n_linked, 0) AS INTEGER) AS n_linked, l.reply_to, up.thread, up.depth
FROM conversations m
JOIN up ON m.conv_id = up.conv_id AND m.turn = up.turn
LEFT JOIN links l ON m.conv_id = l.conv_id AND m.turn = l.turn
LEFT JOIN counts a ON m.conv_id = a.conv_id AND m.turn = a.turn + 1
LEFT JOIN counts b ON m.conv_id = b.conv_id AND m.turn = b.turn + 2
"""


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        sharding.text_bytes().alias("size"),
    )
    placed = sharding.shard_by_bytes(docs, 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP8_SQL = """
WITH tables AS (
  SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT), 0, 1, 2, 3, 4, 5, 6, 7],
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(range(0, length(bytes), 2),
        lambda i: (strpos('0123456789ABCDEF', bytes[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', bytes[i + 2]) - 1)),
      lambda c, byte: xor(crc[(xor(c, byte) & 255) + 1], c >> 8))) AS text_crc32
  FROM sized, tables),
placed AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total
  FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
dealt AS (
  SELECT *, CAST(least(39, (2 * upto - size) * 40 // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures drawn from all embeddings; an edited copy of every one whose id is divisible by 20 looks for its source."""
    # The vectors are few bytes, and the pictures much work: spread them first.
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(partitions(spark), "vec_id")
    stored = images.rendered(rows)
    asked = images.edited(stored.where("image_id % 20 = 0"))
    found = images.find_copies(asked, stored)
    own = found.where("query_id = image_id").select("query_id", F.col("inliers").alias("own_inliers"))
    counted = found.groupBy("query_id").agg(
        F.sum("copies").alias("n_matches"), F.max(F.struct("inliers", (-F.col("image_id")).alias("i"))).alias("best")
    )
    ids = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select("vec_id")
    return ids.join(counted, ids.vec_id == counted.query_id, "left").join(own, "query_id", "left").select(
        "vec_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), (-F.col("best.i")).alias("best_id"),
        F.col("best.inliers").alias("inliers"), F.col("own_inliers").isNotNull().alias("found"),
    )


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.manifest(merkle.document_leaves(docs)).select("doc_id", *merkle.MADE)


OP11_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS ahead,
         -- CRC-32, bit by bit
         xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [CAST(i AS BIGINT) for i in range(8)]),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree,
         sha256(ahead || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256(ahead || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS offered
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS total FROM leaves),
low AS (
  SELECT tree, 0 AS level, place, total, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE total > 1 GROUP BY tree, level, place // 16),
subroots AS (
  SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total
  FROM low WHERE total = 1),
high AS (
  SELECT 0 AS level, place, total, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE total > 1 GROUP BY level, place // 16),
low_sides AS (
  SELECT tree, level, place,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM low WHERE total > 1 WINDOW w AS (PARTITION BY tree, level, place // 16 ORDER BY place)),
high_sides AS (
  SELECT level, place,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM high WHERE total > 1 WINDOW w AS (PARTITION BY level, place // 16 ORDER BY place)),
way AS (
  SELECT p.doc_id, p.leaf, s.level AS step, s.before, s.after
  FROM placed p JOIN low_sides s ON s.tree = p.tree AND s.place = p.place // CAST(pow(16, s.level) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, r.height + s.level, s.before, s.after
  FROM placed p JOIN subroots r ON r.tree = p.tree JOIN high_sides s ON s.place = r.place // CAST(pow(16, s.level) AS BIGINT)),
fold AS (
  SELECT doc_id, leaf, 0 AS step, coalesce(offered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.step + 1, sha256(w.before || f.digest || w.after)
  FROM fold f JOIN way w ON w.doc_id = f.doc_id AND w.leaf = f.leaf AND w.step = f.step),
proofs AS (
  SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, r.subroot, t.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
       f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN subroots r ON r.tree = p.tree JOIN (SELECT digest FROM high WHERE total = 1) t ON true
JOIN (SELECT doc_id, leaf, arg_max(digest, step) AS digest FROM fold GROUP BY doc_id, leaf) f
  ON f.doc_id = p.doc_id AND f.leaf = p.leaf
LEFT JOIN proofs q ON q.doc_id = p.doc_id AND q.leaf = p.leaf
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, by the hash of the id, go on with a part of their words, repeated."""
    h = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY))"
    word = "CASE WHEN i < a THEN w ELSE get(words, CAST(a + (i - a) % p AS INT)) END"
    repeated = bind(
        r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)", "words",
        bind(
            f"{h} div 10 % greatest(size(words), 1)", "a",
            bind(
                f"1 + (size(words) - a) div (3 + {h} div 10 % 8)", "p",
                f"array_join(transform(words, (w, i) -> {word}), ' ')",
            ),
        ),
    )
    return docs.withColumn("text", F.expr(f"CASE WHEN {h} % 10 = 0 THEN {repeated} ELSE text END"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.collapse_runs(_with_periods(docs))
    best = F.expr(
        "aggregate(runs, get(runs, 0), (b, r) -> CASE WHEN r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    lines_of = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(lines_of, 256).alias("runs_sha256"), "collapsed_sha256",
    ).select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_bottom_k": op2_bottom_k,
    "op3_crf_language": op3_crf_language,
    "op4_projections": op4_projections,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_line_spread": op6_line_spread,
    "op7_quote_links": op7_quote_links,
    "op8_byte_shards": op8_byte_shards,
    "op9_image_copies": op9_image_copies,
    "op10_best_fit": op10_best_fit,
    "op11_merkle": op11_merkle,
    "op12_licenses": op12_licenses,
    "op13_periods": op13_periods,
}


def oracles() -> dict[str, str]:
    return {"op6_line_spread": OP6_SQL, "op7_quote_links": OP7_SQL, "op8_byte_shards": OP8_SQL, "op11_merkle": OP11_SQL}

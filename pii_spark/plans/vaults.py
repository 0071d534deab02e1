"""Registered queries: the mapping vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from pii_spark.functions.spans import with_dummies
from pii_spark.operators import vault
from pii_spark.operators.detect import explode_entities
from pii_spark.plans import oracle_parts as sql
from pii_spark.plans.corpora import samples, second_annotation

EPOCH = 1_704_067_200


def _time():
    return F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60)


def _hits(df, salt=""):
    dummies = df.select("doc_id", with_dummies(F.col("entities"), salt).alias("entities"))
    return vault.hits_from_entities(explode_entities(dummies, "doc_id"), _time())


def base_vault(spark, sf):
    return vault.vault_build(_hits(samples(spark, sf)))


def _shown(df):
    return df.select(
        "id", "original_pii", "dummy_pii", "pii_type", "confidence",
        F.unix_timestamp("created_at").alias("created"),
        F.unix_timestamp("last_accessed_at").alias("accessed"), "access_count",
    )


def vault_build(spark, sf):
    return _shown(base_vault(spark, sf))


def vault_upsert(spark, sf):
    later = _hits(second_annotation(samples(spark, sf)), "v2").withColumn(
        "ts", F.col("ts") + F.expr("interval 1 day")
    )
    return _shown(vault.vault_upsert(base_vault(spark, sf), later))


def _keys(spark, sf):
    other = explode_entities(second_annotation(samples(spark, sf)), "doc_id")
    return other.select("doc_id", F.col("text").alias("key"))


def vault_lookup(spark, sf):
    return vault.vault_lookup(_keys(spark, sf), base_vault(spark, sf))


def vault_touch(spark, sf):
    used = _keys(spark, sf).select(F.col("key").alias("original_pii"))
    now = F.timestamp_seconds(F.lit(EPOCH + 10_000_000))
    return _shown(vault.vault_touch(base_vault(spark, sf), used, now))


def vault_delete(spark, sf):
    rows = base_vault(spark, sf)
    cities = rows.where(F.col("pii_type") == "CITY").select("original_pii")
    return _shown(vault.vault_delete(rows, cities))


def _now():
    return F.timestamp_seconds(F.lit(EPOCH + 36_000))


def vault_expire(spark, sf):
    return _shown(vault.vault_expire(base_vault(spark, sf), _now(), "5 hours"))


def vault_expired_count(spark, sf):
    return vault.vault_expired_count(base_vault(spark, sf), _now(), "5 hours")


def vault_count(spark, sf):
    return vault.vault_count(base_vault(spark, sf))


def vault_collisions(spark, sf):
    return vault.vault_collisions(base_vault(spark, sf))


def vault_resolve(spark, sf):
    return vault.vault_resolve(base_vault(spark, sf), rounds=2).select(
        "original_pii", "dummy_pii", F.col("attempt").cast("bigint").alias("attempt"), "suffixed"
    )


def vault_maps(spark, sf):
    s = samples(spark, sf).select("doc_id", with_dummies(F.col("entities")).alias("entities"))
    maps = vault.document_maps(explode_entities(s, "doc_id"))

    def listed(name):
        pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
        return F.array_join(pairs, ";").alias(name)

    return maps.select("doc_id", listed("to_dummy"), listed("to_original"))


def vault_trim(spark, sf):
    return _shown(vault.vault_trim(base_vault(spark, sf), 500))


QUERIES = {
    "vault_build": vault_build,
    "vault_upsert": vault_upsert,
    "vault_lookup": vault_lookup,
    "vault_touch": vault_touch,
    "vault_delete": vault_delete,
    "vault_expire": vault_expire,
    "vault_expired_count": vault_expired_count,
    "vault_count": vault_count,
    "vault_collisions": vault_collisions,
    "vault_resolve": vault_resolve,
    "vault_maps": vault_maps,
    "vault_trim": vault_trim,
}


def _build(name: str, spans: str, salt: str, shift: int) -> str:
    return f"""{sql.with_dummy(name + '_h', spans, salt)},
{name} AS (
  SELECT md5(original) AS id, original AS original_pii,
    min({{'t': {EPOCH + shift} + doc_id * 60, 'l': label, 'd': dummy}}) AS f,
    max({{'t': {EPOCH + shift} + doc_id * 60, 'c': c}}) AS l, count(*) AS access_count
  FROM {name}_h GROUP BY original
)"""


def oracles() -> dict[str, str]:
    base = f"WITH {sql.synthetic()}, {_build('v', 'gold', '', 0)}"
    cols = """id, original_pii, f.d AS dummy_pii, f.l AS pii_type, l.c AS confidence, f.t::BIGINT AS created,
  l.t::BIGINT AS accessed, access_count"""
    other = f"{base}, {sql.second()}"
    resolve = f"{base}, {sql.second()}, r0 AS (SELECT original_pii, f.d AS dummy_pii, f.l AS label, 0 AS attempt FROM v)"
    for i in range(2):
        resolve += f""", w{i} AS (SELECT dummy_pii, min({{'a': attempt, 'o': original_pii}}).o AS o FROM r{i} GROUP BY dummy_pii),
x{i} AS (SELECT r.*, r.original_pii AS original, w.o IS NULL AS lost FROM r{i} r LEFT JOIN w{i} w ON w.o = r.original_pii),
y{i} AS (SELECT *, {sql.dummy_columns('label', 'original', '', str(i + 1))} FROM x{i}),
r{i + 1} AS (SELECT original_pii, CASE WHEN lost THEN {sql.dummy_value()} ELSE dummy_pii END AS dummy_pii, label,
  CASE WHEN lost THEN {i + 1} ELSE attempt END AS attempt FROM y{i})"""
    resolve += """, w2 AS (SELECT dummy_pii, min({'a': attempt, 'o': original_pii}).o AS o FROM r2 GROUP BY dummy_pii)
SELECT original_pii, CASE WHEN w.o IS NULL THEN r.dummy_pii || '-' || md5(original_pii) ELSE r.dummy_pii END AS dummy_pii,
  attempt::BIGINT AS attempt, w.o IS NULL AS suffixed FROM r2 r LEFT JOIN w2 w ON w.o = r.original_pii"""
    return {
        "vault_build": f"{base} SELECT {cols} FROM v",
        "vault_upsert": f"""{other}, {_build('n', 'other', 'v2', 86400)}
SELECT coalesce(v.id, n.id) AS id, coalesce(v.original_pii, n.original_pii) AS original_pii,
  coalesce(v.f.d, n.f.d) AS dummy_pii, coalesce(v.f.l, n.f.l) AS pii_type, coalesce(n.l.c, v.l.c) AS confidence,
  coalesce(v.f.t, n.f.t)::BIGINT AS created, greatest(v.l.t, n.l.t)::BIGINT AS accessed,
  coalesce(v.access_count, 0) + coalesce(n.access_count, 0) AS access_count
FROM v FULL JOIN n ON n.original_pii = v.original_pii""",
        "vault_lookup": f"{other} SELECT o.doc_id, o.original AS key, v.f.d AS found FROM other o LEFT JOIN v ON v.original_pii = o.original",
        "vault_touch": f"""{other}, u AS (SELECT original, count(*) AS n FROM other GROUP BY original)
SELECT id, original_pii, f.d AS dummy_pii, f.l AS pii_type, l.c AS confidence, f.t::BIGINT AS created,
  CASE WHEN u.n IS NULL THEN l.t ELSE {EPOCH + 10_000_000} END::BIGINT AS accessed, access_count + coalesce(u.n, 0) AS access_count
FROM v LEFT JOIN u ON u.original = v.original_pii""",
        "vault_delete": f"{base} SELECT {cols} FROM v WHERE f.l <> 'CITY'",
        "vault_expire": f"{base} SELECT {cols} FROM v WHERE f.t >= {EPOCH + 36_000 - 5 * 3600}",
        "vault_expired_count": f"{base} SELECT count_if(f.t < {EPOCH + 36_000 - 5 * 3600})::BIGINT AS removed, count(*) AS total FROM v",
        "vault_count": f"{base} SELECT count(*) AS rows FROM v",
        "vault_collisions": f"{base} SELECT f.d AS dummy_pii, count(*) AS originals, min(original_pii) AS first_original FROM v GROUP BY f.d HAVING count(*) > 1",
        "vault_resolve": resolve,
        "vault_maps": f"""WITH {sql.synthetic()}, {sql.with_dummy('d', 'gold')},
a AS (SELECT doc_id, original AS k, min(dummy) AS v FROM d GROUP BY doc_id, original),
b AS (SELECT doc_id, dummy AS k, min(original) AS v FROM d GROUP BY doc_id, dummy),
aa AS (SELECT doc_id, string_agg(k || '>' || v, ';' ORDER BY k) AS to_dummy FROM a GROUP BY doc_id),
bb AS (SELECT doc_id, string_agg(k || '>' || v, ';' ORDER BY k) AS to_original FROM b GROUP BY doc_id)
SELECT aa.doc_id, to_dummy, to_original FROM aa JOIN bb ON bb.doc_id = aa.doc_id""",
        "vault_trim": f"{base} SELECT {cols} FROM v ORDER BY l.t DESC, original_pii LIMIT 500",
    }

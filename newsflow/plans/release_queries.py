"""Queries over the release catalogue (groups A5, A6, A10, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators import releases
from newsflow.plans.inputs import load
from newsflow.plans.registry import query
from newsflow.sources import readers


@query(
    "a5_release_metadata",
    """SELECT p_partkey, concat('bundle-', p_partkey, '.tar.gz') AS artifact_name, 'fam' AS family, p_brand AS product,
              CASE WHEN p_partkey % 3 = 0 THEN concat('w', p_size) END AS worker_version,
              CASE WHEN p_partkey % 4 = 0 THEN 'cuda12' END AS runtime_bundle, concat('store/', p_partkey) AS storage_relative_path
       FROM {part} WHERE p_partkey % 10 <> 0""",
)
def release_metadata(spark: SparkSession, sf: str) -> DataFrame:
    [parts] = load(spark, sf, "part")
    n = F.col("p_partkey")
    key = n.cast("string")
    fields = F.concat_ws(
        "\t", F.concat(F.lit("/dist/bundle-"), key, F.lit(".tar.gz")), F.lit("fam"), "p_brand", F.lit("linux"), F.lit("x86_64"),
        F.lit("1.2.3"), F.when(n % 3 == 0, F.concat(F.lit("w"), F.col("p_size").cast("string"))).otherwise(F.lit(" ")),
        F.when(n % 4 == 0, F.lit("cuda12")).otherwise(F.lit("")), F.lit("tar"), F.lit("bearer"), F.concat(F.lit("store/"), key),
    )
    lines = parts.select("p_partkey", F.when(n % 10 == 0, F.lit(" \t ")).otherwise(fields).alias("line"))
    return readers.decode_release_lines(lines).select(
        "p_partkey", "artifact_name", "family", "product", "worker_version", "runtime_bundle", "storage_relative_path"
    )


@query(
    "a6_catalog_source",
    """SELECT p_partkey, CAST(i AS BIGINT) AS item, concat(p_name, '-', i) AS artifact_name, p_type AS product FROM {part}, (VALUES (0), (1), (2)) v(i)
       WHERE i < p_partkey % 4""",
)
def catalog_source(spark: SparkSession, sf: str) -> DataFrame:
    [parts] = load(spark, sf, "part")
    count = (F.col("p_partkey") % 4).cast("int")
    items = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), count),
        lambda i: F.struct(
            F.concat(F.col("p_name"), F.lit("-"), i.cast("string")).alias("artifact_name"), F.col("p_type").alias("product"),
            i.cast("string").alias("sha256"),
        ),
    )
    documents = parts.select("p_partkey", F.to_json(F.struct(items.alias("items"))).alias("value"))
    rows = readers.decode_catalog(documents)
    return rows.select("p_partkey", F.col("sha256").cast("bigint").alias("item"), "artifact_name", "product")


_NAME = "coalesce(nullif(artifact_name, ''), nullif(storage_relative_path, ''))"
_NEW = """SELECT family, product, platform, arch, runtime_bundle, artifact_name, storage_relative_path, '9.9.9' AS latest_version,
                 p_partkey FROM {v_releases} r WHERE p_partkey % 5 = 0"""
_UPSERT = f"""
    SELECT product, platform, runtime_bundle, artifact_name, p_partkey,
           coalesce(nullif(regexp_extract(artifact_name, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1), ''), latest_version) AS latest_version,
           nullif(regexp_extract(artifact_name, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '') AS minimum_supported_version
    FROM {{v_releases}} o WHERE NOT EXISTS (
        SELECT 1 FROM ({_NEW}) n WHERE n.family = o.family AND n.product = o.product AND n.platform = o.platform AND n.arch = o.arch
        AND n.runtime_bundle IS NOT DISTINCT FROM o.runtime_bundle
        AND coalesce(nullif(n.artifact_name, ''), n.storage_relative_path) = coalesce(nullif(o.artifact_name, ''), o.storage_relative_path))
    UNION ALL SELECT product, platform, runtime_bundle, artifact_name, p_partkey, latest_version, latest_version FROM ({_NEW})"""


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    [catalog] = load(spark, sf, "v_releases")
    batch = catalog.where(F.col("p_partkey") % 5 == 0).withColumn("latest_version", F.lit("9.9.9"))
    return releases.upsert_catalog(catalog, batch)


@query("i1_catalog_upsert", _UPSERT)
def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf).select(
        "product", "platform", "runtime_bundle", "artifact_name", "p_partkey", "latest_version", "minimum_supported_version"
    )


@query(
    "a10_catalog_order",
    f"""SELECT product, platform, runtime_bundle, artifact_name, latest_version, p_partkey FROM ({_UPSERT})
        ORDER BY platform, product, coalesce(runtime_bundle, ''), latest_version, artifact_name""",
)
def catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue in published order."""
    return releases.order_catalog(_upserted(spark, sf)).select(
        "product", "platform", "runtime_bundle", "artifact_name", "latest_version", "p_partkey"
    )


@query("i2_identity_key", f"SELECT p_partkey, {_NAME} AS identity_name FROM {{v_releases}} r")
def identity_key(spark: SparkSession, sf: str) -> DataFrame:
    [items] = load(spark, sf, "v_releases")
    return releases.with_identity(items).select("p_partkey", "identity_name")


@query(
    "i3_preserved_repair",
    """SELECT p_partkey, coalesce(nullif(regexp_extract(artifact_name, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1), ''), 'old') AS latest_version,
              coalesce(nullif(regexp_extract(artifact_name, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1), ''), 'older') AS minimum_supported_version
       FROM {v_releases} r""",
)
def preserved_repair(spark: SparkSession, sf: str) -> DataFrame:
    [items] = load(spark, sf, "v_releases")
    stale = items.withColumns({"latest_version": F.lit("old"), "minimum_supported_version": F.lit("older")})
    return releases.repair_preserved(stale).select("p_partkey", "latest_version", "minimum_supported_version")


def _installed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as installs with a version and a manifest key; some versions do not parse."""
    [suppliers] = load(spark, sf, "customer")
    n = F.col("c_custkey")
    version = F.concat_ws(".", (n % 3).cast("string"), (n % 12).cast("string"), (n % 10).cast("string"))
    shown = F.when(n % 17 == 0, F.lit("dev")).when(n % 7 == 0, F.concat(version, F.lit("-rc.1"))).otherwise(version)
    return suppliers.select(
        n.alias("worker"), shown.alias("current_version"), F.concat(F.lit("p"), (n % 60).cast("string")).alias("product"),
        F.lit("linux").alias("platform"), F.lit("x86_64").alias("arch"), F.when(n % 2 == 0, F.lit("cuda12")).alias("runtime_bundle"),
    )


def _manifests(spark: SparkSession, sf: str, parity: int | None) -> DataFrame:
    """Two manifests per key, that of the highest part key and one that is older than any. ``parity`` keeps products of that parity."""
    [items] = load(spark, sf, "v_releases")
    keys = ["product", "platform", "arch", "runtime_bundle"]
    best = items.groupBy(*keys).agg(F.max("p_partkey").alias("k"))
    k = F.col("k")
    minimum = F.concat_ws(".", (k % 2).cast("string"), (k % 5).cast("string"), F.lit("0"))
    latest = F.concat_ws(".", (k % 3).cast("string"), (k % 12).cast("string"), (k % 10).cast("string"))
    rows = best.select(*keys, latest.alias("latest_version"), minimum.alias("minimum_supported_version"))
    rows = rows.unionByName(rows.withColumns({v: F.lit("0.0.0") for v in ("latest_version", "minimum_supported_version")}))
    if parity is None:
        return rows
    return rows.where(F.substring("product", 2, 9).cast("int") % 2 == parity)


_INSTALLED_SQL = """(SELECT c_custkey AS worker, c_custkey % 3 AS a, c_custkey % 12 AS b, c_custkey % 10 AS c, c_custkey % 7 = 0 AS rc, c_custkey % 17 = 0 AS dev,
    CASE WHEN c_custkey % 17 = 0 THEN 'dev' ELSE concat(c_custkey % 3, '.', c_custkey % 12, '.', c_custkey % 10, CASE WHEN c_custkey % 7 = 0 THEN '-rc.1' ELSE '' END) END AS current_version,
    concat('p', c_custkey % 60) AS product, c_custkey % 60 AS pn, CASE WHEN c_custkey % 2 = 0 THEN 'cuda12' END AS runtime_bundle FROM {customer})"""
_MANIFEST_SQL = """(SELECT product, runtime_bundle, k % 3 AS la, k % 12 AS lb, k % 10 AS lc, k % 2 AS ma, k % 5 AS mb,
    concat(k % 3, '.', k % 12, '.', k % 10) AS latest_version, concat(k % 2, '.', k % 5, '.0') AS minimum_supported_version
    FROM (SELECT product, runtime_bundle, max(p_partkey) AS k FROM {v_releases} r WHERE platform = 'linux' GROUP BY ALL))"""
_CHECK = f"""SELECT i.*, m.latest_version, m.minimum_supported_version,
    CASE WHEN m.latest_version IS NULL OR dev THEN 'unverified'
         WHEN (a, b, c, CASE WHEN rc THEN 0 ELSE 1 END) < (ma, mb, 0, 1) THEN 'incompatible'
         WHEN (a, b, c, CASE WHEN rc THEN 0 ELSE 1 END) < (la, lb, lc, 1) THEN 'update_available' ELSE 'up_to_date' END AS status
    FROM {_INSTALLED_SQL} i LEFT JOIN {_MANIFEST_SQL} m ON i.product = m.product AND i.runtime_bundle IS NOT DISTINCT FROM m.runtime_bundle"""


@query(
    "i4_compatibility",
    f"""SELECT worker, status, CASE WHEN latest_version IS NULL THEN 'version manifest unavailable'
               WHEN status = 'incompatible' THEN concat('installed version ', current_version, ' is below minimum supported version ', minimum_supported_version)
               WHEN status = 'update_available' THEN concat('installed version ', current_version, ' is older than latest version ', latest_version)
               WHEN status = 'unverified' THEN 'unable to compare semantic versions' END AS message FROM ({_CHECK})""",
)
def compatibility(spark: SparkSession, sf: str) -> DataFrame:
    return releases.check_releases(_installed(spark, sf), _manifests(spark, sf, None)).select("worker", "status", "message")


@query(
    "i5_live_else_cache",
    f"""SELECT worker, status, coalesce(latest_version IS NOT NULL AND pn % 2 = 1, false) AS from_cache, latest_version FROM ({_CHECK})""",
)
def live_else_cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = releases.check_releases_cached(_installed(spark, sf), _manifests(spark, sf, 0), _manifests(spark, sf, None))
    return rows.select("worker", "status", "from_cache", "latest_version")


@query(
    "i6_fleet_view",
    f"""SELECT worker, u AS requires_update, NOT inst OR u AS show_install_action, NOT alive AND (NOT inst OR u) AS can_install_or_update,
               alive OR (inst AND NOT u) AS can_toggle_run,
               concat(CASE WHEN inst THEN concat('Installed ', current_version) ELSE 'Not installed' END,
                      CASE WHEN latest_version IS NULL THEN '' ELSE concat(' · Latest ', latest_version) END) AS version_line
        FROM (SELECT *, status IN ('update_available', 'incompatible') AS u, worker % 4 <> 0 AS inst, worker % 3 = 0 AS alive FROM ({_CHECK}))""",
)
def fleet_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = releases.check_releases(_installed(spark, sf), _manifests(spark, sf, None))
    flagged = rows.withColumns({"installed": F.col("worker") % 4 != 0, "is_running": F.col("worker") % 3 == 0})
    return releases.fleet_view(flagged).select(
        "worker", "requires_update", "show_install_action", "can_install_or_update", "can_toggle_run", "version_line"
    )


@query("i6_fleet_summary", f"SELECT status, count(*) AS installs FROM ({_CHECK}) GROUP BY status")
def fleet_summary(spark: SparkSession, sf: str) -> DataFrame:
    return releases.fleet_summary(releases.check_releases(_installed(spark, sf), _manifests(spark, sf, None)))

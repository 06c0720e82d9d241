"""Release catalogue: upsert, identity, repair, version compatibility, fleet view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
IDENTITY = ["family", "product", "platform", "arch", "runtime_bundle", "identity_name"]
CATALOG_ORDER = ["family", "platform", "product", "arch", "runtime_bundle", "latest_version", "artifact_name"]
VERSION_IN_NAME = r"(?U)(\d+\.\d+\.\d+)"
SEMVER = (
    r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
    r"(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?"
    r"(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?\z"
)
# -------------------------------------------------------------------------------------------------


def identity_name(items: DataFrame) -> Column:
    """Artifact name, else storage path, else download URL; blanks count as absent."""

    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in items.columns else F.lit(None).cast("string")

    url = F.col("download_url") if "download_url" in items.columns else F.lit(None).cast("string")
    return F.coalesce(given("artifact_name"), given("storage_relative_path"), url)


def with_identity(items: DataFrame) -> DataFrame:
    return items.withColumn("identity_name", identity_name(items))


def repair_preserved(items: DataFrame) -> DataFrame:
    """Latest and minimum version re-read from the artifact name where it holds one."""
    found = F.nullif(F.regexp_extract(F.coalesce("artifact_name", F.lit("")), VERSION_IN_NAME, 1), F.lit(""))
    columns = {"latest_version": F.coalesce(found, F.col("latest_version"))}
    minimum = F.col("minimum_supported_version") if "minimum_supported_version" in items.columns else F.lit(None)
    columns["minimum_supported_version"] = F.coalesce(found, minimum)
    return items.withColumns(columns)


def upsert_catalog(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """Catalogue rows the batch does not replace, repaired, plus the batch with minimum = latest version."""
    fresh = with_identity(batch.withColumn("minimum_supported_version", F.col("latest_version")))
    old = with_identity(catalog)
    keys = fresh.select(*[F.col(k).alias(f"__new_{k}") for k in IDENTITY]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in IDENTITY])
    kept = repair_preserved(old.join(keys, same, "left_anti"))
    return kept.unionByName(fresh, allowMissingColumns=True).drop("identity_name")


def order_catalog(items: DataFrame) -> DataFrame:
    """Total order of the published catalogue; versions compare as text."""
    order = [F.coalesce(F.col(c), F.lit("")) for c in CATALOG_ORDER if c in items.columns]
    return items.orderBy(*order)


def semver(version: Column) -> Column:
    """Comparable form of a semantic version, NULL when it does not parse.

    Numbers become fixed-width text and identifiers get a class prefix, so array order is semver precedence:
    a release sorts above its pre-releases, numeric identifiers below names. Build metadata comes last: none is below
    any, and its identifiers compare like those of a pre-release.
    """

    def number(index: int) -> Column:
        return F.lpad(F.regexp_extract(version, SEMVER, index), 20, "0")

    def identifiers(text: Column) -> Column:
        number_ = F.lit("^[0-9]+$")
        return F.transform(
            F.split(text, r"\."),
            lambda p: F.when(F.rlike(p, number_), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)),
        )

    pre, build = F.regexp_extract(version, SEMVER, 4), F.regexp_extract(version, SEMVER, 5)
    release = F.when(pre == "", F.array(F.lit("2"))).otherwise(identifiers(pre))
    built = F.when(build == "", F.array().cast("array<string>")).otherwise(identifiers(build))
    parsed = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), release.alias("pre"), built.alias("build"))
    return F.when(F.rlike(version, F.lit(SEMVER)), parsed)


def classify_releases(installed: DataFrame) -> DataFrame:
    """Adds ``status`` and ``message`` from current_version, minimum_supported_version and latest_version.

    A row without a manifest has NULL latest_version and NULL minimum_supported_version.
    """
    rows = installed.withColumns(
        {
            "__c": semver(F.col("current_version")),
            "__m": semver(F.col("minimum_supported_version")),
            "__l": semver(F.col("latest_version")),
        }
    )
    c, m, latest = F.col("__c"), F.col("__m"), F.col("__l")
    absent = F.col("latest_version").isNull() & F.col("minimum_supported_version").isNull()
    both = c.isNotNull() & latest.isNotNull()
    status = (
        F.when(both & m.isNotNull() & (c < m), "incompatible")
        .when(both & (c < latest), "update_available")
        .when(both & m.isNotNull(), "up_to_date")
        .otherwise("unverified")
    )
    below = "installed version %s is below minimum supported version %s"
    older = "installed version %s is older than latest version %s"
    message = (
        F.when(absent, "version manifest unavailable")
        .when(F.col("status") == "incompatible", F.format_string(below, "current_version", "minimum_supported_version"))
        .when(F.col("status") == "update_available", F.format_string(older, "current_version", "latest_version"))
        .when(F.col("status") == "unverified", "unable to compare semantic versions")
    )
    return rows.withColumn("status", status).withColumn("message", message).drop("__c", "__m", "__l")


MANIFEST_KEY = ["product", "platform", "arch", "runtime_bundle"]


def _match_manifest(installed: DataFrame, manifests: DataFrame, prefix: str) -> DataFrame:
    """Left join on the manifest key; NULL runtime bundles match each other. Of manifests with one key the newest counts."""
    versions = ["latest_version", "minimum_supported_version"]
    order = F.struct(*[x for v in versions for x in (semver(F.col(v)), F.col(v))])
    named = manifests.groupBy(*[F.coalesce(F.col(k), F.lit("")).alias(f"__{k}") for k in MANIFEST_KEY]).agg(
        F.max_by(F.struct(*versions), order).alias(prefix)
    )
    same = reduce(
        lambda a, b: a & b,
        [F.coalesce(installed[k], F.lit("")) == named[f"__{k}"] for k in MANIFEST_KEY],
    )
    return installed.join(named, same, "left").drop(*[f"__{k}" for k in MANIFEST_KEY])


def check_releases(installed: DataFrame, live: DataFrame) -> DataFrame:
    """Installed rows (current_version and manifest key) classified against the live manifests."""
    rows = _match_manifest(installed, live, "__live")
    return classify_releases(
        rows.withColumns(
            {
                "latest_version": F.col("__live.latest_version"),
                "minimum_supported_version": F.col("__live.minimum_supported_version"),
            }
        ).drop("__live")
    )


def check_releases_cached(installed: DataFrame, live: DataFrame, cached: DataFrame) -> DataFrame:
    """Live manifest, else the cached one flagged ``from_cache``, else unverified."""
    rows = _match_manifest(_match_manifest(installed, live, "__live"), cached, "__cached")
    used = F.coalesce("__live", "__cached")
    rows = rows.withColumns(
        {
            "from_cache": F.col("__live").isNull() & F.col("__cached").isNotNull(),
            "latest_version": used.latest_version,
            "minimum_supported_version": used.minimum_supported_version,
        }
    ).drop("__live", "__cached")
    return classify_releases(rows)


def installed_version(version: Column) -> Column:
    return F.when(F.trim(F.coalesce(version, F.lit(""))) == "", F.lit("0.0.0")).otherwise(version)


def fleet_view(classified: DataFrame) -> DataFrame:
    """Action flags of every worker from status, installed and is_running."""
    update = F.coalesce(F.col("status").isin("update_available", "incompatible"), F.lit(False))
    installed, alive = F.col("installed"), F.col("is_running")
    suffix = F.coalesce(F.concat(F.lit(" · Latest "), F.col("latest_version")), F.lit(""))
    line = F.concat(
        F.when(installed, F.concat(F.lit("Installed "), installed_version(F.col("current_version")))).otherwise(
            F.lit("Not installed")
        ),
        suffix,
    )
    return classified.withColumns(
        {
            "requires_update": update,
            "version_line": line,
            "show_install_action": ~installed | update,
            "can_install_or_update": ~alive & (~installed | update),
            "can_toggle_run": alive | (installed & ~update),
            "can_uninstall": installed & ~alive,
            "install_label": F.when(installed, "Update").otherwise("Install"),
            "run_label": F.when(alive, "Stop").otherwise("Start"),
        }
    )


def release_notice(classified: DataFrame, name: Column) -> DataFrame:
    """Warning or danger notice of a worker's release status."""
    running_tail = " has an update available. Stop it before installing the latest bundle."
    idle_tail = " has an update available. Install the latest bundle before starting it."
    waiting = F.col("status") == "update_available"
    text = (
        F.when(waiting & F.col("is_running"), F.concat(name, F.lit(running_tail)))
        .when(waiting, F.concat(name, F.lit(idle_tail)))
        .when(F.col("status") == "incompatible", F.concat(name, F.lit(" must be updated before it can start.")))
    )
    tone = F.when(waiting, "warning").when(F.col("status") == "incompatible", "danger")
    return classified.withColumns({"tone": tone, "notice": text})


def fleet_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("installs"))

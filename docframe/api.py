"""A project from its sources to pages, index and report."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import markup
from docframe.operators import cache as cache_
from docframe.operators import references as R
from docframe.operators import rules, site
from docframe.operators import statistics as S
from docframe.operators import toctree as C
from docframe.operators.indexing import checkpointed
from docframe.sources import config as G
from docframe.sources import files as I


@dataclass
class Build:
    """What a build made; hits: how many documents the cache served."""

    docs: DataFrame
    records: DataFrame
    diagnostics: DataFrame
    config: dict
    hits: int = 0

    def counts(self) -> dict[str, int]:
        """Documents, warnings, errors and cache hits."""
        r = self.diagnostics.agg(F.count_if(F.col("severity") == "warning"), F.count_if(F.col("severity") == "error")).first()
        return {"documents": self.docs.count(), "warnings": r[0], "errors": r[1], "cache_hits": self.hits}

    def exit_code(self) -> int:
        return S.exit_code(self.diagnostics, self.config["fail_on_warning"])


def build(spark: SparkSession, folder: str, output: str | None = None, overrides: list[str] | None = None, cache: str | None = None) -> Build:
    """Reads, parses and checks the project in a folder; writes pages and the report where
    output is given, and takes pages of unchanged sources from the cache in a folder, which
    it then brings up to date. A cache of another configuration serves nothing."""
    if output and (why := site.overlap(folder, output)):
        raise ValueError(why)
    config, dropped = G.load(folder)
    config, warnings = G.override(config, overrides or [])
    docs, unread = I.texts(I.project(spark, folder, config["include_patterns"], config["exclude_patterns"]))
    # parsed once; what follows reads the records
    records = checkpointed(markup.parse(docs.where(F.col("format") == "rst")))

    def notes(df: DataFrame, severity: str, message) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.concat("doc", F.lit(".rst")).alias("file"), F.col("line").cast("long").alias("line"), message.alias("message"))

    said = spark.createDataFrame([("warning", "conf.py", n, what) for n, what in dropped] + [("warning", "conf.py", None, w) for w in warnings], "severity string, file string, line long, message string")
    entries = records.where("kind = 'toctree'").select(F.col("doc").alias("docname"), "target", F.map_contains_key("options", "glob").alias("glob"), "line")
    missing = entries.join(C.missing(entries, docs), ["docname", "target"]).withColumnRenamed("docname", "doc")
    dead = entries.join(C.glob_hits(entries, docs).where("hit IS NULL"), ["docname", "target"]).withColumnRenamed("docname", "doc")
    lost = C.orphans(entries, docs, config["root_doc"]).select(F.col("docname").alias("doc"), F.lit(None).cast("long").alias("line"))
    phases = [(said, "config"), (notes(missing, "warning", S.MISSING(F.col("resolved"))), "toctree"), (notes(dead, "warning", S.NO_MATCH(F.col("target"))), "toctree"), (notes(lost, "warning", F.lit(S.ORPHAN)), "orphan")]
    if config["validate_directives"]:
        for kind, table in (("directive", rules.DIRECTIVES), ("role", rules.ROLES)):
            bad = rules.checked(records.where(F.col("kind") == kind), table).where("outcome IN ('warning', 'error')")
            phases.append((notes(bad, "warning", F.concat_ws(": ", "name", "message")), kind))
    if config["nitpicky"]:
        refs = records.where("kind = 'role'").select(F.col("doc").alias("docname"), "name", "target", "line").withColumn("type", R.kind(F.col("name"))).where("type IN ('document', 'reference')")
        refs = refs.where(~R.is_external(F.col("type"), F.col("target")))
        names = R.targets(*(records.where(F.col("kind") == k).select("name", F.col("doc").alias("docname"), "ord") for k in ("label", "section")))
        lost_docs = R.resolve_documents(refs.where("type = 'document'"), docs).where("found IS NULL").select("docname", "target", "line")
        lost_refs = R.resolve_labels(refs.where("type = 'reference'"), names).where("found IS NULL").select("docname", "target", "line")
        phases.append((notes(lost_docs.union(lost_refs).withColumnRenamed("docname", "doc"), "warning", S.BROKEN(F.col("target"))), "reference"))
    phases.append((unread, "read"))
    report = S.report(*phases)
    hits = 0
    if output:
        if cache:
            hits = _cached_pages(spark, docs, config, f"{output}/pages", cache)
        else:
            I.write_pages(docs, f"{output}/pages")
        S.write_report(report, f"{output}/report")
    return Build(docs, records, report, config, hits)


def _cached_pages(spark: SparkSession, docs: DataFrame, config: dict, output: str, folder: str) -> int:
    """Writes all pages, those of the cache as they are there; the number of these."""
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    mark = F.lit(json.dumps(config, sort_keys=True, default=str))
    files = docs.select("path", "docname", "content", F.md5(F.concat(F.col("content"), F.col("mtime").cast("string"), mark)).alias("hash"), F.col("mtime").cast("timestamp").alias("mtime"))
    old = cache_.load(spark, folder, files, now, config["cache_expiration_hours"] * 3600)
    planned = cache_.plan(files, old, now, config["cache_expiration_hours"] * 3600)
    hits = cache_.served(planned, old)
    built = files.join(hits.select("path"), "path", "left_anti")
    html = I.page(F.col("content"))
    fresh = built.select("path", "hash", "mtime", F.lit(now).cast("timestamp").alias("cached_at"), F.lit(0).cast("long").alias("access_count"), cache_.size_of(html, F.col("docname"), F.col("path")).cast("long").alias("size_bytes"), html.alias("html"))
    used = old.drop("access_count").join(hits.select("path", "access_count"), "path").select(*fresh.columns)
    all_ = checkpointed(used.union(fresh))
    all_.select(F.regexp_replace("path", r"\.[^./]+$", ".html").alias("path"), "html").write.mode("overwrite").parquet(output)
    cache_.persist(cache_.stored_within(all_.where("access_count > 0"), all_.where("access_count = 0"), config["max_cache_size_mb"] << 20), folder)
    return all_.where("access_count > 0").count()


def clean(source: str, output: str, cache: str | None = None) -> None:
    """Empties the output folder, and the cache's."""
    site.cleaned(source, output, *([cache] if cache else []))


def main(arguments: list[str]) -> int:
    """build SOURCE OUTPUT, clean SOURCE OUTPUT, stats SOURCE, or SOURCE OUTPUT; options
    -W (warnings fail), -n (nitpicky), -D key=value, -j jobs. The exit code; 2 for a
    command line or a build that can't run."""
    from docframe.session import local_session

    try:
        rest = list(arguments)
        command = "build" if site.by_folders(rest) else rest.pop(0) if rest else ""
        places, overrides, count = [], [], "auto"
        while rest:
            x = rest.pop(0)
            if x in ("-W", "--fail-on-warning"):
                overrides.append("fail_on_warning=true")
            elif x in ("-n", "--nitpicky"):
                overrides.append("nitpicky=true")
            elif x == "-D":
                overrides.append("=".join(G.pair(rest.pop(0))))
            elif x in ("-j", "--jobs"):
                count = rest.pop(0)
            elif x.startswith("-"):
                raise ValueError(f"unknown option {x}")
            else:
                places.append(x)
        if command not in ("build", "clean", "stats") or len(places) != (1 if command == "stats" else 2):
            raise ValueError("build SOURCE OUTPUT, clean SOURCE OUTPUT or stats SOURCE is needed")
        if command == "clean":
            clean(*places)
            return 0
        spark = local_session(site.jobs(count))
        if command == "stats":
            stats(spark, places[0]).show()
            return 0
        return build(spark, *places, overrides).exit_code()
    except (ValueError, IndexError, OSError) as e:
        print(e)
        return S.exit_code(None)


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row of statistics of a project."""
    files = I.project(spark, folder)
    return S.project(files.withColumn("content", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))))

"""Object inventories: lines, compressed files, and the general index."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"^(.+?)\s+(\S+)\s+(-?\d+)\s+?(\S*)\s+(.*)$"


def lines(objects: DataFrame) -> DataFrame:
    """(line) of objects (name, domain, type, priority, uri, anchor, display), in order: an
    anchor that ends with the name has '$' for it, a display that is the name '-'."""
    short = F.when(F.col("anchor").endswith(F.col("name")), F.concat(F.substring("anchor", F.lit(1), F.length("anchor") - F.length("name")), F.lit("$"))).otherwise(F.col("anchor"))
    place = F.when(F.coalesce(F.col("anchor"), F.lit("")) == "", F.col("uri")).otherwise(F.concat("uri", F.lit("#"), short))
    shown = F.when(F.col("display") == F.col("name"), F.lit("-")).otherwise(F.col("display"))
    return objects.select(F.format_string("%s %s:%s %d %s %s", "name", "domain", "type", "priority", place, shown).alias("line"))


def parsed(rows: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, type, priority, uri, display), after the columns to keep, of inventory
    lines; those of another form, or whose type has no ':', go. '$' at the end of a
    place is the name, '-' as display too."""
    part = [F.regexp_extract(line, LINE, k) for k in range(1, 6)]
    rows = rows.where(F.col(line).rlike(LINE)).select(*keep, *[p.alias(c) for p, c in zip(part, ["name", "type", "priority", "uri", "display"], strict=True)])
    rows = rows.where(F.col("type").contains(":"))
    uri = F.when(F.col("uri").endswith("$"), F.concat(F.expr("substring(uri, 1, length(uri) - 1)"), "name")).otherwise(F.col("uri"))
    return rows.select(*keep, "name", "type", F.col("priority").cast("long").alias("priority"), uri.alias("uri"), F.when(F.col("display") == "-", F.col("name")).otherwise(F.col("display")).alias("display"))


def header(tool: str, project: str, version: str) -> bytes:
    """The four lines before the compressed part; tool is the name that readers look for."""
    one = [" ".join(x.split()) for x in (project, version)]
    return f"# {tool} inventory version 2\n# Project: {one[0]}\n# Version: {one[1]}\n# The remainder of this file is compressed using zlib.\n".encode()


def file_of(objects: DataFrame, tool: str, project: str = "", version: str = "") -> bytes:
    """The whole file; the driver holds one line of each object while it is compressed."""
    z = zlib.compressobj()
    out = [header(tool, project, version)]
    for r in lines(objects).orderBy("line").toLocalIterator():
        out.append(z.compress((r.line + "\n").encode()))
    return b"".join([*out, z.flush()])


def read_v1(files: DataFrame) -> DataFrame:
    """(path, name, type, uri) of the old format, files (path, content as text): three fields a line after the header."""
    each = files.select("path", F.explode(F.split("content", "\n")).alias("l")).where(~F.col("l").startswith("#") & (F.trim("l") != ""))
    p = F.split(F.trim("l"), r"\s+")
    mod = p[1] == "mod"
    out = each.where(F.size(p) == 3).select("path", p[0].alias("name"), F.when(mod, F.lit("py:module")).otherwise(F.concat(F.lit("py:"), p[1])).alias("type"), F.concat(p[2], F.when(mod, F.lit("#module-")).otherwise(F.lit("#")), p[0]).alias("uri"))
    return out


def read_v2(files: DataFrame) -> DataFrame:
    """(path, name, type, priority, uri, display) of compressed inventories, files
    (path, content as bytes) such as the binaryFile source gives; a file that can't be read has no rows."""

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    out.append(zlib.decompress(raw.split(b"\n", 4)[4]).decode("utf-8", "replace"))
                except (AttributeError, IndexError, zlib.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "body"])

    body = files.select("path", "content").mapInArrow(unpack, "path string, body string")
    each = body.select("path", F.explode(F.split("body", "\n")).alias("line"))
    return parsed(each, keep=("path",))


def index_entries(rows: DataFrame, text: str = "entry") -> DataFrame:
    """(letter, entry, subentry) of index entries such as 'single: a; b', 'pair: a; b',
    'triple: a; b; c' or plain ones, of which commas divide several; '!' marks a main entry. Letter is '_' where no letter begins the entry."""
    kind = F.lower(F.regexp_extract(text, r"(?i)^(single|pair|double|triple|seealso|see)\s*:", 1))
    kind = F.when(kind == "double", "pair").otherwise(kind)
    body = F.trim(F.regexp_replace(text, r"(?i)^(single|pair|double|triple|seealso|see)\s*:\s*", ""))
    body = F.regexp_replace(body, r"^!\s*", "")
    p = F.transform(F.split(body, ";"), lambda x: F.trim(x))
    a, b, c = F.get(p, 0), F.get(p, 1), F.get(p, 2)

    def pair(x, y):
        return F.struct(x.alias("entry"), y.alias("subentry"))

    none = F.lit(None).cast("string")
    made = (
        F.when((kind == "pair") & b.isNotNull(), F.array(pair(a, b), pair(b, a)))
        .when((kind == "triple") & c.isNotNull(), F.array(pair(a, F.concat_ws(" ", b, c)), pair(b, F.concat_ws(", ", c, a)), pair(c, F.concat_ws(" ", a, b))))
        .when(kind.isin("see", "seealso") & b.isNotNull(), F.array(pair(a, F.concat_ws(" ", F.when(kind == "see", F.lit("see")).otherwise(F.lit("see also")), b))))
        .when((kind == "single") | (kind == ""), F.array(pair(a, b)))
        .otherwise(F.array(pair(a, none)))
    )
    rows = rows.withColumn(text, F.explode(F.when(F.col(text).rlike(r"(?i)^(single|pair|double|triple|seealso|see)\s*:"), F.array(text)).otherwise(F.split(text, r"\s*,\s*"))))
    out = rows.select(F.explode(made).alias("x")).select("x.entry", "x.subentry").where("entry <> ''")
    first = F.upper(F.substring("entry", 1, 1))
    return out.select(F.when(first.rlike(r"^\p{L}$"), first).otherwise(F.lit("_")).alias("letter"), "entry", "subentry")

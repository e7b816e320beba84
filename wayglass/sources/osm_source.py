"""OpenStreetMap XML as a data source of its own: `spark.read.format("osm")`.

Options: `kind` (node, way or relation), `tags` (comma-separated keys that become string columns, null where the object hasn't the tag), `split` (bytes of a task, 64 MB
by default). Files are cut by bytes, and a task reads the objects that start in its part. Comparisons of ids, versions, coordinates and tag columns with
constants are evaluated while reading, before an object's members and other tags become a row; everything else is left to Spark. A path is a file, a gzip file (one
task), or a folder, on any file system that pyarrow knows.

`<` in attribute values has to be escaped, as XML asks for; comments and CDATA must not hold objects.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from wayglass.functions import roads

COLUMNS = {
    "node": "id long, version int, lat double, lon double",
    "way": "id long, version int, refs array<long>",
    "relation": "id long, version int, members array<struct<type:string,ref:long,role:string>>",
}
PLAIN = ("id", "version", "lat", "lon")
_ATTRIBUTE = re.compile(rb"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_CHILD = re.compile(rb"""<(tag|nd|member)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_HEAD = re.compile(rb"""<\w+\b((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_COMPARE = {
    EqualTo: lambda x, v: None if x is None or v is None else x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: None if x is None else (x in v) or (None if None in v else False),
    GreaterThan: lambda x, v: None if x is None else x > v, GreaterThanOrEqual: lambda x, v: None if x is None else x >= v, LessThan: lambda x, v: None if x is None else x < v, LessThanOrEqual: lambda x, v: None if x is None else x <= v,
    StringContains: lambda x, v: None if x is None else v in x, StringStartsWith: lambda x, v: None if x is None else x.startswith(v), StringEndsWith: lambda x, v: None if x is None else x.endswith(v),
}


def attributes(part: bytes) -> dict[str, str]:
    return {k.decode(): html.unescape((a if a is not None else b).decode()) for k, a, b in ((m[1], m[2], m[3]) for m in _ATTRIBUTE.finditer(part))}


def holds(test: Filter, values: dict) -> bool | None:
    """What a condition says of an object: true, false or unknown, as in SQL."""
    if isinstance(test, Not):
        inner = holds(test.child, values)
        return None if inner is None else not inner
    x = values.get(test.attribute[0])
    if isinstance(test, IsNull):
        return x is None
    if isinstance(test, IsNotNull):
        return x is not None
    return _COMPARE[type(test)](x, test.value)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end, and the file can't be cut


class OsmReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.kind, self.tags = options.get("kind", "way"), [t.strip() for t in options.get("tags", "").split(",") if t.strip()]
        self.path, self.split, self.schema, self.tests = options["path"], int(options.get("split", 64 << 20)), schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {c for c in PLAIN if c in self.schema.names} | set(self.tags)
        for f in filters:
            test = f.child if isinstance(f, Not) else f
            if len(test.attribute) == 1 and test.attribute[0] in known and type(test) in (*_COMPARE, IsNull, IsNotNull):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        from pyarrow import fs

        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out = []
        for f in files:
            if f.path.endswith(".gz"):
                out.append(Part(f.path, 0, None))
            else:
                out += [Part(f.path, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        target = pa.schema([_arrow(f) for f in self.schema.fields])
        rows: list[dict] = []
        for element in self._elements(part):
            row = self._row(element)
            if row is not None:
                rows.append(row)
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_pylist(rows, schema=target)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    def _elements(self, part: Part) -> Iterator[bytes]:
        """The objects that start in the part, as they stand in the file."""
        system, _ = _open(self.path)
        name = self.kind.encode()
        start, close = re.compile(rb"<" + name + rb"[\s/>]"), b"</" + name + b">"
        stream = system.open_input_stream(part.path, compression="gzip") if part.end is None else system.open_input_file(part.path)
        with stream:
            if part.end is not None:
                stream.seek(part.start)
            held, at, base = stream.read(1 << 22), 0, part.start
            while held:
                m = start.search(held, at)
                if m and part.end is not None and base + m.start() >= part.end:
                    return
                end = -1
                if m:
                    head = _HEAD.match(held, m.start())
                    if head:
                        end = head.end() if head[1].endswith(b"/") else held.find(close, head.end())
                        end = end if end < 0 or head[1].endswith(b"/") else end + len(close)
                if end >= 0:
                    yield held[m.start() : end]
                    at = end
                    continue
                if not m and part.end is not None and base + len(held) >= part.end + len(name) + 2:
                    return
                # an object that isn't whole yet, or none: read on, and keep what may be its start
                keep = m.start() if m else max(at, len(held) - len(name) - 2)
                more = stream.read(1 << 22)
                if not more:
                    return
                held, base, at = held[keep:] + more, base + keep, 0

    def _row(self, element: bytes) -> dict | None:
        head = _HEAD.match(element)
        own = attributes(head[1])
        number = lambda key, kind: kind(own[key]) if own.get(key) else None
        row = {"id": number("id", int), "version": number("version", int), "lat": number("lat", float), "lon": number("lon", float)}
        children = [(m[1], m[2]) for m in _CHILD.finditer(element, head.end())]
        tags = {}
        for kind, body in children:
            if kind == b"tag":
                a = attributes(body)
                tags[a.get("k", "")] = a.get("v", "")
        row |= {t: tags.get(t) for t in self.tags}
        if not all(holds(f, row) is True for f in self.tests):
            return None
        if self.kind == "way":
            row["refs"] = [int(attributes(b)["ref"]) for k, b in children if k == b"nd"]
        if self.kind == "relation":
            members = (attributes(b) for k, b in children if k == b"member")
            row["members"] = [{"type": a.get("type"), "ref": int(a["ref"]), "role": a.get("role")} for a in members]
        row["all_tags"] = list(tags.items())
        return row


def _arrow(field) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType))


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):  # Hadoop writes file:/a as well as file:///a
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class OsmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm"

    def schema(self) -> str:
        kind = self.options.get("kind", "way")
        if kind not in COLUMNS:
            raise ValueError(f"kind is node, way or relation, not {kind}")
        tags = [t.strip() for t in self.options.get("tags", "").split(",") if t.strip()]
        base = COLUMNS[kind]
        taken = {c.split()[0] for c in base.split(", ")} | {"all_tags"}
        if len(set(tags)) < len(tags) or taken & set(tags):
            raise ValueError(f"tags that can't be columns beside {sorted(taken)}: {tags}")
        return ", ".join([base, *[f"`{t}` string" for t in tags], "all_tags map<string,string>"])

    def reader(self, schema: StructType) -> OsmReader:
        return OsmReader(dict(self.options), schema)


def scan(spark: SparkSession, path: str, kind: str, tags: tuple[str, ...] = (), split: int | None = None) -> DataFrame:
    """Objects of a kind: its columns, one for each of `tags`, and all_tags. Filters on all but refs, members and all_tags are evaluated by the source."""
    spark.dataSource.register(OsmSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("osm").option("kind", kind).option("tags", ",".join(tags))
    return (reader.option("split", split) if split else reader).load(path)


def drivable_ways(spark: SparkSession, path: str, include_service: bool = False) -> DataFrame:
    """id, refs, tags, class, kmh, fwd, rev, roundabout of ways that cars use. The highway class and `area` are tested by the source; service roads without a name stay out unless asked for."""
    ways = scan(spark, path, "way", ("highway", "area")).filter(F.col("highway").isin(*roads.DEFAULT_KMH) & ~F.col("area").eqNullSafe("yes"))
    ways = ways.select("id", "refs", F.col("all_tags").alias("tags")).withColumn("class", roads.drivable()).filter("class is not null and size(refs) >= 2")
    if not include_service:
        ways = ways.filter((F.col("class") != "service") | roads.named_service())
    way = roads.directions()
    return ways.select("*", roads.speed().alias("kmh"), way["fwd"].alias("fwd"), way["rev"].alias("rev"), F.coalesce(roads.tag("tags", "junction").isin("roundabout", "circular"), F.lit(False)).alias("roundabout"))


def signals(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon of traffic signals."""
    return scan(spark, path, "node", ("highway",)).filter("highway = 'traffic_signals'").select("id", "lat", "lon")


def turn_restrictions(spark: SparkSession, path: str) -> DataFrame:
    """rid, kind, from_way, via, to_way, supported. What a restriction for cars says goes before what it says for all; those that except cars are left out, and
    those with other than one way, one node and one way, or of an unknown kind, aren't supported."""
    found = scan(spark, path, "relation", ("type", "restriction", "restriction:motorcar", "except")).filter("type = 'restriction'")
    some = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(""))
    found = found.filter(~F.array_contains(F.split(F.coalesce("except", F.lit("")), ";"), "motorcar")).withColumn("kind", F.coalesce(some("restriction:motorcar"), some("restriction"), F.lit("")))
    role = lambda name, kind: F.transform(F.filter("members", lambda m: (m["role"] == name) & (m["type"] == kind)), lambda m: m["ref"])
    found = found.select(F.col("id").alias("rid"), "kind", role("from", "way").alias("f"), role("via", "node").alias("v"), role("to", "way").alias("t"), F.exists("members", lambda m: (m["role"] == "via") & (m["type"] != "node")).alias("long"))
    one = (F.size("f") == 1) & (F.size("v") == 1) & (F.size("t") == 1) & ~F.col("long") & (F.startswith("kind", F.lit("no_")) | F.startswith("kind", F.lit("only_")))
    return found.select("rid", "kind", F.get("f", F.lit(0)).alias("from_way"), F.get("v", F.lit(0)).alias("via"), F.get("t", F.lit(0)).alias("to_way"), one.alias("supported"))


def element(kind: str, columns: str, tags: str = "tags") -> Column:
    """An object's XML, of the columns that become attributes, `refs` or `members`, and a map of tags."""

    def text(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    own = F.concat(*[F.coalesce(F.concat(F.lit(f' {c}="'), F.col(c).cast("string"), F.lit('"')), F.lit("")) for c in columns.split()])
    inner = F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat(F.lit('<tag k="'), text(e["key"]), F.lit('" v="'), text(e["value"]), F.lit('"/>'))), "")
    if kind == "way":
        inner = F.concat(F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), ""), inner)
    if kind == "relation":
        member = lambda m: F.concat(F.lit('<member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), text(m["role"]), F.lit('"/>'))
        inner = F.concat(F.array_join(F.transform("members", member), ""), inner)
    return F.concat(F.lit(f"<{kind}"), own, F.lit(">"), inner, F.lit(f"</{kind}>"))

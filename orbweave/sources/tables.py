"""Sources and sinks: catalogs, climate index files, networks, polygons."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.frames import frame
from ..schema import Network


def read_catalog_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A catalog with a header line; types come from the schema, nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=True)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def convert_pickle(spark: SparkSession, path: str, out: str) -> None:
    """One-off: a pickled pandas frame (trusted files only; it is read on the driver) to Parquet."""
    spark.createDataFrame(pd.read_pickle(path)).write.parquet(out)


def read_index_text(spark: SparkSession, path: str, missing: str = r"-99\.90", skip: int = 1) -> DataFrame:
    """(year, m1..m12) of white-space separated lines; lines with a missing value anywhere and the first ``skip`` lines go."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_n"))
    a = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("_n") >= skip).withColumn("a", a).where((F.size("a") == 13) & ~F.exists("a", lambda x: x.rlike(missing)))
    return rows.select(F.col("a")[0].cast("int").alias("year"), *[F.col("a")[i].cast("double").alias(f"m{i}") for i in range(1, 13)])


def write_network(net: Network, path: str, *partitions: str) -> None:
    """``nodes`` and ``edges`` as Parquet, partitioned by class columns that they have."""
    for name, df in (("nodes", net.nodes), ("edges", net.edges)):
        df.write.partitionBy(*[p for p in partitions if p in df.columns]).parquet(f"{path}/{name}")


def read_network(spark: SparkSession, path: str, directed: bool = True) -> Network:
    return Network(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), directed)


def _gml(nodes: pd.DataFrame, edges: pd.DataFrame, directed: bool) -> str:
    text = lambda v: f'"{v}"' if isinstance(v, str) else repr(v.item() if hasattr(v, "item") else v)
    body = lambda row, skip: "".join(f"    {k} {text(v)}\n" for k, v in row.items() if k not in skip and not pd.isna(v))
    at = {k: i for i, k in enumerate(nodes["coord_id"])}
    out = ["graph [\n  directed %d\n" % directed]
    for r in nodes.to_dict("records"):
        out.append(f'  node [\n    id {at[r["coord_id"]]}\n    label "{r["coord_id"]}"\n{body(r, ("coord_id",))}  ]\n')
    for r in edges.to_dict("records"):
        out.append(f"  edge [\n    source {at[r['orig']]}\n    target {at[r['dest']]}\n{body(r, ('orig', 'dest'))}  ]\n")
    return "".join(out) + "]\n"


def write_gml(edges: DataFrame, nodes: DataFrame, path: str, by: str = "realization", directed: bool = True) -> None:
    """One GML document for each realization (nodes are shared), in a folder of its own."""
    own = nodes.toPandas().sort_values("coord_id")  # a grid's nodes: their number is fixed by its resolution
    keep = [c for c in edges.columns if c != by]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return frame({by: [part[by].iloc[0]], "value": [_gml(own, part[keep].sort_values(["orig", "dest"]), directed)]})

    kind = edges.schema[by].dataType.simpleString()
    edges.groupBy(by).applyInPandas(run, f"{by} {kind}, value string").repartition(by).write.partitionBy(by).text(path)


def _parse_gml(text: str) -> tuple[dict, list[dict]]:
    """Labels by id, and the edges' fields."""
    import re

    labels, edges, kind, row = {}, [], None, {}
    for token in re.finditer(r'(\w+)\s*(\[|"[^"]*"|[^\s\[\]]+)|(\])', text):
        if token[3]:
            if kind == "node":
                labels[row["id"]] = row.get("label", row["id"])
            elif kind == "edge":
                edges.append(row)
            kind, row = None, {}
        elif token[2] == "[":
            kind, row = token[1], {}
        else:
            row[token[1]] = token[2].strip('"')
    return labels, edges


def read_gml(spark: SparkSession, path: str, by: str = "realization") -> DataFrame:
    """(realization, orig, dest, weight) of GML documents; each is parsed in a task of its own."""
    files = spark.read.text(path, wholetext=True)
    files = files if by in files.columns else files.withColumn(by, F.lit(0))
    kind = files.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                labels, edges = _parse_gml(b.column(0)[i].as_py())
                ends = [pa.array([labels[e[k]] for e in edges], pa.string()) for k in ("source", "target")]
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(1)[i], len(edges)), *ends, pa.array([float(e.get("weight", 1)) for e in edges], pa.float64())], names=[by, "orig", "dest", "weight"])

    return files.select("value", by).mapInArrow(run, f"{by} {kind}, orig string, dest string, weight double")


def gexf(net: Network) -> str:
    """One network as a GEXF document (node ids become strings). It is built on the driver: for grids, not for bulk data."""
    root = ET.Element("gexf", xmlns="http://gexf.net/1.2draft", version="1.2")
    graph = ET.SubElement(root, "graph", defaultedgetype="directed" if net.directed else "undirected")
    for kind, df, key in (("node", net.nodes, ["coord_id"]), ("edge", net.edges, ["orig", "dest"])):
        names = [c for c in df.columns if c not in (*key, "weight")]
        defs = ET.SubElement(graph, "attributes", {"class": kind})
        for i, c in enumerate(names):
            ET.SubElement(defs, "attribute", id=str(i), title=c, type="string" if dict(df.dtypes)[c] == "string" else "double")
        box = ET.SubElement(graph, f"{kind}s")
        for j, r in enumerate(df.orderBy(*key).toLocalIterator()):
            own = {"id": str(r.coord_id), "label": str(r.coord_id)} if kind == "node" else {"id": str(j), "source": str(r.orig), "target": str(r.dest), "weight": str(r.weight)}
            item = ET.SubElement(box, kind, own)
            values = ET.SubElement(item, "attvalues")
            for i, c in enumerate(names):
                if r[c] is not None:
                    ET.SubElement(values, "attvalue", {"for": str(i), "value": str(r[c])})
    return ET.tostring(root, encoding="unicode")


def parse_gexf(spark: SparkSession, text: str) -> DataFrame:
    """(orig, dest, weight) of a GEXF document; ids are strings."""
    rows = [(e.get("source"), e.get("target"), float(e.get("weight", 1))) for e in ET.fromstring(text).iter() if e.tag.endswith("}edge") or e.tag == "edge"]
    return spark.createDataFrame(rows, "orig string, dest string, weight double")


def geojson(cells: DataFrame, boundary: str = "boundary") -> DataFrame:
    """``value``: each row as a GeoJSON feature, its polygon from ``boundary``, the rest as properties."""
    ring = F.transform(boundary, lambda p: F.array(p["lon"], p["lat"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    rest = [c for c in cells.columns if c != boundary]
    return cells.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Polygons of GeoJSON features, one a line: the columns of ``properties`` (a DDL string) and ``boundary``, the outer ring.

    Lines that are no feature are left out; a missing geometry gives NULL.
    """
    own = ", ".join(c.strip().replace(" ", ": ", 1) for c in properties.split(","))
    shape = f"type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<{own}>"
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return rows.where("f.type = 'Feature'").select("f.properties.*", ring.alias("boundary"))


def flow_tree(levels: DataFrame, rates: DataFrame) -> DataFrame:
    """``value``: a line 'path flow "node" node' for each node, path being its community at each level."""
    path = levels.groupBy("node").agg(F.concat_ws(":", F.transform(F.sort_array(F.collect_list(F.struct("level", "community"))), lambda x: x["community"].cast("string"))).alias("path"))
    return path.join(rates, "node").select(F.format_string('%s %.9f "%s" %s', "path", "rate", F.col("node").cast("string"), F.col("node").cast("string")).alias("value"))

"""The driver's Parquet tables as a graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..terms import XSD
from .graph import TableGraph, TableMap

EX = "http://ex/"


def table_map(spark: SparkSession, sf_dir: str, name: str) -> TableMap:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    string, double, integer, long, stamp = XSD + "string", XSD + "double", XSD + "int", XSD + "long", XSD + "dateTime"

    def ref(t: str) -> tuple[str, str]:
        return ("ref", f"{EX}{t}/")

    keys = {
        "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
        "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"),
        "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "embeddings": ("vec_id",), "conversations": ("conv_id", "turn"),
    }
    columns: dict[str, dict[str, tuple[str, object]]] = {
        "region": {"name": ("r_name", string)},
        "nation": {"name": ("n_name", string), "region": ("n_regionkey", ref("region"))},
        "customer": {"name": ("c_name", string), "nation": ("c_nationkey", ref("nation")), "acctbal": ("c_acctbal", double), "segment": ("c_mktsegment", string)},
        "supplier": {"name": ("s_name", string), "nation": ("s_nationkey", ref("nation")), "acctbal": ("s_acctbal", double)},
        "part": {"name": ("p_name", string), "brand": ("p_brand", string), "ptype": ("p_type", string), "size": ("p_size", integer), "price": ("p_retailprice", double)},
        "orders": {"customer": ("o_custkey", ref("customer")), "status": ("o_orderstatus", string), "total": ("o_totalprice", double), "date": ("o_orderdate", stamp), "priority": ("o_orderpriority", string)},
        "lineitem": {"order": ("l_orderkey", ref("orders")), "part": ("l_partkey", ref("part")), "supplier": ("l_suppkey", ref("supplier")), "line": ("l_linenumber", integer), "quantity": ("l_quantity", double), "discount": ("l_discount", double), "shipdate": ("l_shipdate", stamp), "flag": ("l_returnflag", string)},
        "events": {"time": ("ts", stamp), "user": ("user_id", long), "event": ("event_type", string), "value": ("value", double), "props": ("props", string)},
        "documents": {"text": ("text", ("lang", "lang")), "source": ("source", string), "chars": ("n_chars", long)},
        "labels": {"quality": ("quality", integer), "toxic": ("toxic", integer)},
        "pages": {"url": ("url", ("ref", "")), "html": ("html", string)},
        "benchmark": {"text": ("text", string)},
        "conversations": {"role": ("role", string), "said": ("text", string)},
    }
    cls = name[0].upper() + name[1:].removesuffix("s") if name not in ("embeddings",) else "Embedding"
    mapped = {f"<{EX}{k}>": v for k, v in columns.get(name, {}).items()}
    if name == "conversations":
        df = df.withColumn("_next", F.concat(F.col("conv_id"), F.lit("-"), F.col("turn") + 1))
    if name == "lineitem":
        # quantity and price tell repeated line numbers apart
        df = df.withColumn("_k", F.concat_ws("-", *[F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], F.date_format("l_shipdate", "yyyyMMdd"), (F.round(F.col("l_extendedprice") * 100)).cast("long")))
        return TableMap(name, df, (f"{EX}lineitem/", "_k"), EX + cls, mapped)
    return TableMap(name, df, (f"{EX}{name}/", *keys[name]), EX + cls, mapped)


def lists_of_roles(spark: SparkSession, sf_dir: str) -> TableMap:
    """Each conversation with its roles as a list, in order of turns."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.getField("role"))
    return TableMap("talks", df.groupBy("conv_id").agg(roles.alias("roles")), (f"{EX}talk/", "conv_id"), EX + "Talk", {}, lists={f"<{EX}roles>": ("roles", XSD + "string")})


def graph(spark: SparkSession, sf_dir: str, *names: str) -> TableGraph:
    return TableGraph(spark, [table_map(spark, sf_dir, n) for n in names])

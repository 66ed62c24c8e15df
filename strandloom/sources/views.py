"""Alignment, interval and call tables as views over order tables.

Each view is the same select list for Spark and for the SQL that checks it; ``end`` is the only name
that the two quote differently. Spark takes places as long: keys of large tables put them above 2^31.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SELECTS = {
    "reads": (
        "lineitem join orders on l_orderkey = o_orderkey",
        [
            "cast(l_suppkey % 5 as int) as tid",
            "cast(l_partkey * 500 + l_orderkey % 500 as int) as start",
            "cast(l_partkey * 500 + l_orderkey % 500 + 50 + cast(l_quantity as int) as int) as {end}",
            "cast(l_quantity as int) as mapq",
            "concat('B', cast(o_custkey as varchar(20))) as bcd",
            "cast(l_linenumber % 3 as int) as hptype",
            "concat('R', cast(l_orderkey as varchar(20))) as read_id",
            "cast((case when l_returnflag = 'R' then 16 else 0 end) + (case when l_linenumber % 2 = 1 then 64 else 128 end)"
            " + (case when l_linestatus = 'F' and l_discount > 0.085 then 1024 else 0 end) as int) as flag",
            "cast(l_linenumber as int) as line",
            "case when l_linenumber % 4 = 1 then concat(cast(l_linenumber * 3 as varchar(9)), 'S', cast(50 + cast(l_quantity as int) as varchar(9)), 'M')"
            " when l_linenumber % 4 = 2 then concat('20M', cast(l_linenumber as varchar(9)), 'D', cast(30 + cast(l_quantity as int) - cast(l_linenumber as int) as varchar(9)), 'M4H')"
            " when l_linenumber % 4 = 3 then concat('10M2I', cast(40 + cast(l_quantity as int) as varchar(9)), '=7S')"
            " else concat(cast(50 + cast(l_quantity as int) as varchar(9)), 'M') end as cigar",
        ],
    ),
    "regions": ("part", ["cast(p_partkey % 5 as int) as tid", "cast(p_partkey * 500 as int) as start", "cast(p_partkey * 500 + p_size * 20 as int) as {end}", "p_brand as label", "p_partkey as region_id"]),
    "gaps": ("supplier", ["cast(s_suppkey % 5 as int) as tid", "cast(s_suppkey * 7919 as int) as start", "cast(s_suppkey * 7919 + 5000 as int) as {end}", "s_suppkey as gap_id"]),
    "variants": (
        "lineitem",
        [
            "concat('chr', cast(l_suppkey % 5 + 1 as varchar(9))) as chrom",
            "cast(l_partkey * 500 + l_orderkey % 500 as int) as pos",
            "case l_returnflag when 'A' then 'A' when 'N' then 'AC' else 'G' end as ref",
            "case l_linestatus when 'O' then 'G' else 'T' end as alt",
            "cast(l_quantity as int) as qual",
            "cast(l_linenumber * 10 as int) as depth",
            "cast(l_linenumber as int) as line",
            "l_orderkey as ok",
        ],
    ),
    # letters stand for bases, anything else for an unknown base
    "seqs": (
        "documents",
        [
            "doc_id as name",
            "regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N'{g}) as seq",
        ],
    ),
    "sessions": ("events", ["concat('U', cast(user_id as varchar(20))) as bcd", "event_id", "ts"]),
}


def view_sql(name: str) -> str:
    """The view as SQL with ANSI quotes."""
    source, cols = SELECTS[name]
    return f"select {', '.join(cols)} from {source}".replace("{end}", '"end"').replace("{g}", ", 'g'")


def duck(body: str, *names: str) -> str:
    """``body`` with the views that it names."""
    body = body.lstrip()
    recursive = body.lower().startswith("with recursive ")
    rest = body[len("with recursive ") :] if recursive else body[len("with ") :] if body.lower().startswith("with ") else None
    head = ("with recursive " if recursive else "with ") + ", ".join(f"{n} as ({view_sql(n)})" for n in names)
    return f"{head}, {rest}" if rest is not None else f"{head} {body}"


def widened(cols: list[str]) -> list[str]:
    """A select list whose places (``start``, ``end``, ``pos``) are long instead of int."""
    return [re.sub(r"^cast\((.*) as int\) as (start|\{end\}|pos)$", r"cast(\1 as bigint) as \2", c) for c in cols]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols = SELECTS[name]
    tables = source.split(" join ")
    df = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
    if len(tables) > 1:
        right, on = tables[1].split(" on ")
        a, b = on.split(" = ")
        other = spark.read.parquet(f"{sf_dir}/{right}.parquet")
        df = df.join(other, df[a] == other[b])
    return df.selectExpr(*[c.replace("{end}", "`end`").replace("{g}", "") for c in widened(cols)])

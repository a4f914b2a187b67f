"""The engine's tables, derived from the supplied star schema by the same SQL on any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellar.storage import spread

#: Derived table to SQL; {name} stands for a supplied table.
DERIVATIONS = {
    "memories": """select doc_id as id, case when doc_id % 5 = 0 then 'archive' else 'global' end as namespace, concat('doc-', cast(doc_id as varchar(20))) as name,
 case doc_id % 9 when 0 then 'user' when 1 then 'feedback' when 2 then 'project' when 3 then 'reference' when 4 then 'decision' when 5 then 'incident' when 6 then 'skill' when 7 then 'document' else 'note' end as type,
 substr(text,1,100) as description, text as body, lang, source, n_chars,
 cast(1700000000 + doc_id*60 as bigint) as created_at, cast(1700000000 + doc_id*60 + (doc_id % 7)*3600 as bigint) as updated_at,
 case when doc_id % 17 = 0 then cast(1710000000 + doc_id as bigint) end as deleted_at from {documents}""",
    "memory_versions": """select doc_id as memory_id, v as version, concat('doc-', cast(doc_id as varchar(20))) as name, substr(text,1,cast(floor(length(text)*v/3.0) as int)) as body,
 case when v = 1 then 'create' when doc_id % 11 = 0 and v = 3 then 'restore' else 'edit' end as change_reason, cast(1700000000 + doc_id*60 + v*100 as bigint) as created_at
 from {documents} cross join (select 1 as v union all select 2 union all select 3) z where v <= 1 + doc_id % 3""",
    "memory_embeddings": "select vec_id as memory_id, embedding, label from {embeddings}",
    "entities": """select cast(1000000 + r_regionkey as bigint) as id, 'global' as namespace, concat('region-', cast(r_regionkey as varchar(20))) as name, 'location' as type from {region}
 union all select cast(2000000 + n_nationkey as bigint), 'global', concat('nation-', cast(n_nationkey as varchar(20))), 'location' from {nation}
 union all select cast(3000000 + s_suppkey as bigint), 'global', concat('supplier-', cast(s_suppkey as varchar(20))), 'organization' from {supplier}
 union all select cast(4000000 + c_custkey as bigint), 'global', concat('customer-', cast(c_custkey as varchar(20))), 'person' from {customer}
 union all select cast(5000000 + p_partkey as bigint), 'global', concat('part-', cast(p_partkey as varchar(20))), 'tool' from {part}""",
    "relationships": """select 'global' as namespace, cast(2000000+n_nationkey as bigint) as source_id, cast(1000000+n_regionkey as bigint) as target_id, 'applies_to' as relation, cast(0.9 as double) as weight from {nation}
 union all select 'global', cast(2000000+n_nationkey as bigint), cast(2000000+(n_nationkey*7+1) % 25 as bigint), 'follows', round(cast(0.3 as double)+cast(0.02 as double)*n_nationkey,2) from {nation} where (n_nationkey*7+1) % 25 <> n_nationkey
 union all select 'global', cast(2000000+s_nationkey as bigint), cast(3000000+s_suppkey as bigint), 'related', cast(0.5 as double) from {supplier}
 union all select 'global', cast(4000000+c_custkey as bigint), cast(2000000+c_nationkey as bigint), 'related', cast(0.4 as double) from {customer}
 union all select 'global', cast(3000000+l_suppkey as bigint), cast(5000000+l_partkey as bigint), 'uses', round(least(cast(1.0 as double), sum(l_quantity)/150),4) from {lineitem} where l_partkey % 10 = 0 group by l_suppkey, l_partkey""",
    "memory_entities": """select doc_id as memory_id, cast(2000000 + doc_id % 25 as bigint) as entity_id from {documents} where doc_id % 4 <> 3
 union select doc_id, cast(5000000 + (select min(p_partkey) from {part}) + doc_id % 200 as bigint) from {documents} where doc_id % 3 = 0""",
    "entity_embeddings": "select cast(case when vec_id < 25 then 2000000 + vec_id else 4000000 + vec_id end as bigint) as entity_id, embedding from {embeddings}",
    "queue": """select event_id as id, 'global' as namespace, case user_id % 3 when 0 then 'ReEmbed' when 1 then 'MemoryBindings' else 'EntityConnect' end as operation,
 concat('item-', cast(event_id as varchar(20))) as item_key, case event_type when 'signup' then 'done' when 'purchase' then 'processing' when 'error' then 'dead' else 'pending' end as status,
 case when value > 100 then 1 else 0 end as priority, cast(event_id % 10 as int) as attempt, cast(1700000000 + event_id*30 as bigint) as claimed_at from {events}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Corpus:
    """Lazy frames of the supplied and the derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            # Texts are costly row by row.
            self._read[name] = spread(df) if name == "documents" else df
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVATIONS:
            sql = DERIVATIONS[name].replace("varchar(20)", "string")
            used = {t: self.table(t) for t in TABLES if "{" + t + "}" in sql}
            return self.spark.sql(sql, **used)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def with_tables(body: str) -> str:
    """DuckDB SQL: the derived tables that ``body`` names, as common table expressions before it."""
    import re

    need = [t for t in DERIVATIONS if re.search(rf"\b{t}\b", body)]
    ctes = [f"{t} as ({DERIVATIONS[t].format(**{x: x for x in TABLES})})" for t in need]
    head, rest = ("with recursive ", body.strip()[len("with recursive") :].strip()) if body.strip().lower().startswith("with recursive") else ("with ", body.strip()[4:].strip() if body.strip().lower().startswith("with ") else "")
    if rest:
        return head + ", ".join([*ctes, rest])
    return (head + ", ".join(ctes) + " " if ctes else "") + body.strip()

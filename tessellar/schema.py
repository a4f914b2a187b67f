"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# DDL strings: spark readers take them as they are.
MEMORIES = "id bigint, namespace string, name string, type string, description string, body string, body_hash string, session_id string, source string, metadata string, deleted_at bigint, created_at bigint, updated_at bigint"
VERSIONS = "id bigint, memory_id bigint, version bigint, name string, type string, description string, body string, metadata string, changed_by string, change_reason string, created_at bigint"
CHUNKS = "id bigint, memory_id bigint, chunk_idx bigint, chunk_text string, start_offset bigint, end_offset bigint, token_count bigint"
ENTITIES = "id bigint, namespace string, name string, type string, description string, aliases array<string>, degree bigint, metadata string, created_at bigint, updated_at bigint"
RELATIONSHIPS = "id bigint, namespace string, source_id bigint, target_id bigint, relation string, weight double, description string, metadata string, created_at bigint, updated_at bigint"
BRIDGE = "memory_id bigint, entity_id bigint"
EMBEDDINGS = "id bigint, namespace string, embedding array<float>, source string, model string, dim int"
BATCH_LINE = "name string, type string, description string, body string, entities array<struct<name:string,entity_type:string,type:string,description:string>>, relationships array<struct<source:string,`from`:string,target:string,`to`:string,relation:string,strength:double,weight:double,description:string>>"
QUEUE = "id bigint, namespace string, operation string, item_key string, item_type string, status string, memory_id bigint, entity_id bigint, attempt int, error string, error_class string, next_retry_at bigint, claimed_at bigint, priority int"

# The closed vocabularies of the data model.
MEMORY_TYPES = ["user", "feedback", "project", "reference", "decision", "incident", "skill", "document", "note"]
MEMORY_SOURCES = ["agent", "user", "system", "import", "sync"]
ENTITY_TYPES = ["project", "tool", "person", "file", "concept", "incident", "decision", "memory", "dashboard", "issue_tracker", "organization", "location", "date"]
RELATIONS = ["applies_to", "uses", "depends_on", "causes", "fixes", "contradicts", "supports", "follows", "related", "mentions", "replaces", "tracked_in"]

#: Widths that a stored vector may have.
DIM_RANGE = (8, 4096)


def memory_violations(memories: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule of the memory table; all zero for a valid snapshot."""
    rules: dict[str, Column] = {
        "type": ~F.col("type").isin(MEMORY_TYPES),
        "source": ~F.col("source").isin(MEMORY_SOURCES),
        "description": F.length("description") > 500,
        "body": F.octet_length("body") > 512_000,
        "name": ~F.col("name").rlike(r"^[a-z][a-z0-9-]{0,78}[a-z0-9]$|^[a-z0-9]$"),
    }
    own = {k: v for k, v in rules.items() if k in memories.columns}
    counted = memories.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in own.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in own])).alias("x")).select("x.rule", "x.n")

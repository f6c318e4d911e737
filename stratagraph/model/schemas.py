"""Node and edge vocabularies and table schemas. The type columns stay open: any string is accepted."""

from pyspark.sql import types as T

#: Node types (fixed values).
NODE_TYPES = [
    "REPOSITORY", "COMMIT", "COMMIT_MESSAGE", "AUTHOR", "TIME_BUCKET", "FILE", "SYMBOL", "FUNCTION", "FUNCTION_HISTORY", "FUNCTION_VERSION",
    "SECRET", "COMMENT", "KEYWORD", "PULL_REQUEST", "CLICKUP_TASK", "AST_NODE",
]
#: Edge types (fixed values).
EDGE_TYPES = [
    "PART_OF_REPO", "PARENT_OF", "HAS_MESSAGE", "AUTHORED_BY", "COMMITTED_BY", "OCCURRED_IN", "MODIFIED_FILE", "REFERENCES_ENV", "HAS_SYMBOL", "MODIFIED_SYMBOL",
    "MODIFIED_FUNCTION", "HAS_HISTORY", "HAS_VERSION", "CREATED_VERSION", "PREVIOUS_VERSION", "HAS_COMMENT", "CONTAINS_COMMENT", "HAS_KEYWORD",
    "RELATED_TO_PR", "RELATED_TO_TASK", "CONTEXTUAL_SYMBOL", "HAS_AST_NODE", "CURRENT_VERSION",
]
#: How a vector hit leads to commits: node type, edge type, whether the node is the edge's source (fixed values).
VECTOR_HITS = [("SYMBOL", "MODIFIED_SYMBOL", True), ("FUNCTION", "MODIFIED_FUNCTION", False), ("PULL_REQUEST", "RELATED_TO_PR", False), ("CLICKUP_TASK", "RELATED_TO_TASK", False)]
SELF_HITS = ["COMMIT", "COMMIT_MESSAGE", "COMMIT_SYMBOLS"]
#: Types a walk ends at unless asked for, and edges that are no dependencies (fixed values).
NO_EXPAND = ["AUTHOR", "TIME_BUCKET", "REPOSITORY"]
STRUCTURAL = ["CONTAINS_COMMENT", "HAS_KEYWORD"]

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())
NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("attributes", ATTRIBUTES)])
EDGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("attributes", ATTRIBUTES)])
AMENDMENTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("timestamp", T.DoubleType()), T.StructField("action", T.StringType()), T.StructField("entity_type", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("reverted", T.IntegerType())])
EMBEDDINGS = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("chunk_id", T.IntegerType()), T.StructField("node_type", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

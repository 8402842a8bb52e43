"""The node table: one row per node of a tree document, with interval encoding.

``pre`` numbers the nodes of a document in document order (attributes follow their element), ``last_desc`` is the largest
``pre`` below a node, so "d lies below a" is ``a.pre < d.pre <= a.last_desc``. Every join of nodes starts with equality
of doc_id: documents are the unit of distribution.
"""

from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("pre", T.LongType()),
        T.StructField("last_desc", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("sib_pos", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
    ]
)
NODE_COLUMNS = NODE_SCHEMA.names
#: Void elements of HTML (fixed by the HTML standard).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

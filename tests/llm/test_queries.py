import os

import pytest

from stratagraph.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {"p2_found": ["commit_id", "forced"], "p3_found": ["node_a", "chunk_a", "node_b", "chunk_b"], "p4_found": ["author_a", "author_b"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_stated_columns_and_types(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    assert {t for c, t in df.dtypes if c not in ("commit_id", "node_a", "node_b")} <= {"bigint"}


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(queries.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            assert all("stratagraph.llm" not in open(os.path.join(folder, f)).read() for f in files if f.endswith(".py"))

"""Tables in the shared folder."""

import ast
from pathlib import Path
from types import SimpleNamespace

import pytest

from tracewell import storage

ROOT = Path(__file__).parents[1]


def test_cut_and_drop(spark):
    df = storage.cut(spark.range(10).selectExpr("id", "cast(null as string) as x"), "t")
    assert df.count() == 10 and df.schema.names == ["id", "x"]
    folder = Path(next(iter(df.inputFiles())).removeprefix("file://")).parent
    storage.drop_cut(df)
    assert not folder.exists()


def test_cluster_needs_a_shared_folder():
    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=storage.PLACE):
        storage.shared_dir(session)
    conf[storage.PLACE] = "hdfs:///shared/"
    assert storage.shared_dir(session) == "hdfs:///shared"


def test_nothing_else_imports_the_optional_package():
    """The training-data operators may be deleted; only the entry file and the pipeline name them."""
    for path in (ROOT / "tracewell").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tracewell.llm") for n in names), path

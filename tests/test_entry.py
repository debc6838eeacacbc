import json
import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from lamina.sources import adopt, column, load, store

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.exists(), reason="no sample tables")
def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources_and_sink(spark, tmp_path):
    got = adopt(spark, pd.DataFrame({"pos": [0, 1], "value": [1.5, None]}))
    assert got.count() == 2
    assert column(spark, [255], "uint8").schema["value"].dataType.simpleString() == "smallint"
    store(column(spark, [1, 2, 3]), str(tmp_path / "t.parquet"))
    assert load(spark, str(tmp_path), "t").count() == 3


def test_importable_without_the_optional_parts():
    root = Path(entry.__file__).parent
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('lamina.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e, json\n"
        "print(json.dumps(sorted(e.queries())))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout.splitlines()[-1])
    assert "pipeline_q6" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)

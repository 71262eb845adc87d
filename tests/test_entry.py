"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
EXTRA = ("furrow/llm", "tests/llm", "corpus_pipeline.py")


@pytest.mark.parametrize("leftover", [False, True])
def test_the_rest_stands_alone(tmp_path, leftover):
    for name in ("furrow", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in EXTRA:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    if leftover:  # a folder that only holds what an import left behind
        (tmp_path / "furrow/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(s) <= set(q) and not any(n.startswith('op1') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_gates_refuse():
    from furrow.operators import registry

    good = {"scheme": "random", "streams": [{"name": "random", "monitor": True}], "metrics": ["rmse"]}
    assert registry.gate(good) is good
    with pytest.raises(ValueError, match="0 monitors"):
        registry.gate({**good, "streams": []})
    with pytest.raises(KeyError, match="no median among metrics"):
        registry.find("metrics", "median")

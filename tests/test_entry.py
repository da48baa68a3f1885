"""The entry imports with and without the document operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), any(n[:2] == 'op' for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


def shown(folder):
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    return run.stdout.split(), run.stderr


@pytest.mark.parametrize("gone", [(), ("llm",), ("llm", "pipeline"), ("pipeline",), ("modules",)])
def test_imports(tmp_path, gone):
    there = os.path.isdir(f"{ROOT}/pagetab/llm") and os.path.exists(f"{ROOT}/corpus_pipeline.py")
    skip = shutil.ignore_patterns("__pycache__", *(["llm"] if "llm" in gone else []))
    shutil.copytree(f"{ROOT}/pagetab", tmp_path / "pagetab", ignore=skip)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if there and "pipeline" not in gone:
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    if "modules" in gone and there:
        for name in os.listdir(tmp_path / "pagetab/llm"):
            os.remove(tmp_path / "pagetab/llm" / name)
    out, err = shown(tmp_path)
    assert out and out[1] == str(there and not {"llm", "modules"} & set(gone)), err
    assert out[2] == str(there and not gone)


def test_other_missing_modules_are_errors(tmp_path):
    if not os.path.isdir(f"{ROOT}/pagetab/llm"):
        pytest.skip("nothing to break")
    shutil.copytree(f"{ROOT}/pagetab", tmp_path / "pagetab", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    with open(tmp_path / "pagetab/llm/common.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    out, err = shown(tmp_path)
    assert not out and "a_module_that_is_not_there" in err

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_a_callable_and_sql_names_exist():
    import __spark_entry__ as entry

    assert all(callable(q) for q in entry.queries().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def _copy(path, *, without):
    shutil.copytree(HERE, path, ignore=lambda folder, names: [n for n in names if n.startswith(".") or os.path.relpath(os.path.join(folder, n), HERE) in without])
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=path, env={**os.environ, "PYTHONPATH": str(path)}, capture_output=True, text=True)


def test_entry_imports_without_the_llm_subpackage(tmp_path):
    """Both folders and the pipeline are deleted from a copy."""
    got = _copy(tmp_path / "copy", without=("corpus_pipeline.py", "wharfline/llm", "tests/llm"))
    names = got.stdout.split()
    assert got.returncode == 0 and len(names) >= 70, got.stderr
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)


def test_a_fault_inside_the_subpackage_is_an_error(tmp_path):
    path = tmp_path / "copy"
    assert _copy(path, without=()).returncode == 0
    with open(path / "wharfline/plans/registry.py", "a") as f:
        f.write("\n")
    name = "wharfline/" + "llm/shared.py"
    if os.path.exists(path / name):
        with open(path / name, "a") as f:
            f.write("\nimport no_such_library\n")
        code = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=path, env={**os.environ, "PYTHONPATH": str(path)}, capture_output=True, text=True)
        assert code.returncode and "no_such_library" in code.stderr

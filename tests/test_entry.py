import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def test_the_entry_works_without_the_text_operators(tmp_path):
    """Also where the pipeline's file is left behind."""
    shutil.copytree(HERE / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path)
    told = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, text = map(int, done.stdout.split()[-2:])
    assert n >= 90 and text == 0

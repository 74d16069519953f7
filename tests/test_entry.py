import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_works_without_the_training_data_part():
    code = "import sys; sys.modules['regionpairs.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'best_hit' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_that_part():
    for f in (ROOT / "regionpairs").rglob("*.py"):
        if "llm" not in f.parts:
            assert ".llm" not in f.read_text(), f

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50 and all(0 <= r.score <= 100 for r in rows)


def test_every_query_is_registered_once():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80


def test_entry_works_without_the_optional_part(tmp_path):
    (tmp_path / "sitelens").mkdir()
    for path in REPO.glob("sitelens/*"):
        if path.name != "llm":
            (tmp_path / "sitelens" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op')))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0 and int(said.stdout.split()[0]) > 70 and said.stdout.split(" ", 1)[1].strip() == "[]", said.stderr

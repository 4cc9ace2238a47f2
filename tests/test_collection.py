import subprocess
import sys
from pathlib import Path


def test_every_file_is_collected():
    """Two files of one name, as tests/test_oracle.py and tests/llm/test_oracle.py, do not shut each other out."""
    here = Path(__file__).resolve().parent
    run = subprocess.run([sys.executable, "-m", "pytest", str(here), "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=here.parent, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout[-1500:]
    for path in here.rglob("test_*.py"):
        assert f"{path.relative_to(here.parent)}::" in run.stdout

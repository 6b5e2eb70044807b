"""Every plan module can be imported first."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", ["base", "catalogue", "context", "custom", "dynamics", "evaluation", "extended", "models", "panels", "refits", "registry"])
def test_alone(name):
    subprocess.run([sys.executable, "-c", f"import tessera.plans.{name}"], cwd=ROOT, check=True, timeout=120)

"""Every Python worker imports the tables made from the Unicode database, so making them takes little time."""

import subprocess
import sys

SCRIPT = "import time; t = time.process_time(); import maskwright.functions.fixed; print(time.process_time() - t)"


def test_tables_are_made_in_little_time():
    took = subprocess.run([sys.executable, "-c", SCRIPT], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True, check=True).stdout
    assert float(took) < 6

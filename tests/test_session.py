import os
import subprocess
import sys

from encephalake.session import materialise, shared_dir

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from encephalake.session import get_session, materialise, shared_dir
spark = get_session("configured", cores=1, spark__checkpoint__dir={folder!r})
assert shared_dir(spark) == {folder!r}
df = materialise(spark.range(5).selectExpr("id * 2 as v"), "t")
assert sorted(r.v for r in df.collect()) == [0, 2, 4, 6, 8]
"""


def test_scratch_folder_is_stable_within_a_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert materialise(spark.range(3)).count() == 3


def test_configured_folder_is_used(tmp_path):
    """In a process of its own: the folder is a setting of the Spark context."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = SCRIPT.format(root=root, folder=str(tmp_path))
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120)
    assert any(p.name.startswith("t-") for p in tmp_path.iterdir())

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from shelfscan.session import get_spark

    s = get_spark("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


FILES = "id long, path string, name string, ext string, size long, mtime double, indexed double, chars long, status string, error string, is_dir int, phash string, fhash string, kind string, simhash long, dhash long"


@pytest.fixture(scope="session")
def make_files(spark):
    """Rows of files from dicts; what is left out is null."""
    columns = [c.split()[0] for c in FILES.split(", ")]

    def make(*rows):
        out = []
        for k, r in enumerate(rows):
            path = r.get("path", f"/a/f{k}")
            base = {"id": k + 1, "path": path, "name": None if path is None else path.replace("\\", "/").split("/")[-1], "ext": ".txt", "is_dir": 0, "status": "ok", "chars": 0}
            out.append(tuple((base | r).get(c) for c in columns))
        return spark.createDataFrame(out, FILES)

    return make

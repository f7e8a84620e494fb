import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from linkloom.schema import PAGE  # noqa: E402
from linkloom.session import local_session  # noqa: E402
from linkloom.sources.records import page_records  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def page(url, title, text, *, h1=None, blocks=None, lang="en", content=(), other=(), meta=""):
    """One PAGE row; blocks as (tag, text) or (tag, text, links, anchors)."""
    full = [(b[0], b[1], b[1], list(b[2]) if len(b) > 2 else [], list(b[3]) if len(b) > 3 else [])
            for b in (blocks if blocks is not None else [("p", text)])]
    return (None, url, None, lang, title, title if h1 is None else h1, meta, "", url, text, text, full, list(content), [], list(other), False)


@pytest.fixture
def pages_of(spark):
    return lambda rows: page_records(spark.createDataFrame(rows, PAGE))

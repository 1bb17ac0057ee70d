import time

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string, taken string, segments string"
LONG = "Der lange Satz steht hier. " * 8000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, and columns with clashing names."""
    extra = (0.5, 3, "k", "t", "s")
    rows = [
        (1, None, "de", "a", 0, *extra),
        (2, "", "de", "a", 0, *extra),
        (3, " \n\t ", "en", None, 3, *extra),
        (4, LONG, "de", "b", len(LONG), *extra),
        (5, "Short text here, nothing more to say.", "en", "b", 36, *extra),
        (5, "Short text here, nothing more to say.", "en", "b", 36, *extra),
        (6, "SHORT text here, nothing more\nto say.", None, "b", 36, *extra),
        (None, "Short text here, nothing more to say.", "en", "b", 36, *extra),
        (7, "日本語 😀 \x00 é <|endoftext|> ok", "ja", "c", 20, *extra),
        (8, "12 34 !!", "en", None, 8, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def cost():
    """cost(call): least CPU time of three calls, as a multiple of a stable sort of a million numbers just before and after."""
    keys = np.random.default_rng(1).integers(0, 1 << 40, 1 << 20)

    def least(call):
        times = []
        for _ in range(3):
            began = time.process_time()
            call()
            times.append(time.process_time() - began)
        return min(times)

    def measured(call):
        sort = lambda: np.argsort(keys, kind="stable")
        return 2 * least(call) / (least(sort) + least(sort))

    return measured

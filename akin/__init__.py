"""Approximate matching and record linkage on Spark DataFrames."""

from __future__ import annotations

import atexit
import importlib
import os
import shutil
import tempfile
import zipfile

#: The root names and where they live; modules are loaded when a name is first asked for.
_NAMES = {
    "create_scorer": "operators.scorer", "is_match": "operators.scorer", "score_if_match": "operators.scorer", "Scorer": "operators.scorer",
    "normalize_text": "functions.expressions", "tokens": "functions.expressions",
    "search": "operators.search", "best_match": "operators.search", "search_iter": "operators.search", "create_matcher": "operators.search",
    "create_indexed_matcher": "operators.search", "prepare_choices": "operators.search", "matched": "operators.search",
    "score_matrix": "operators.batch", "score_pairs": "operators.batch", "partial_ratio_alignment": "operators.alignment", "Editops": "operators.editops", "Opcodes": "operators.editops",
    **{name: "functions.metrics" for name in (
        "levenshtein", "indel", "lcs", "osa", "damerau_levenshtein", "hamming", "jaro", "jaro_winkler", "prefix", "postfix", "dice", "cosine", "tversky",
        "ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "token_ratio", "partial_token_sort_ratio", "partial_token_set_ratio", "partial_token_ratio", "weighted_ratio",
    )},
}
_shipped: set[str] = set()


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(importlib.import_module(f"{__name__}.{_NAMES[name]}"), name)
    raise AttributeError(name)


def __dir__() -> list[str]:
    return sorted([*globals(), *_NAMES])


#: Bytes of an Arrow batch between JVM and Python, where the session keeps Spark's 64 MB.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m")


def prepare(spark) -> None:
    """Give the executors this package's code, once an application, and bound Arrow batches.

    The code is needed where the package isn't installed on executors. Long texts make batches
    of ten thousand rows large, and each is held by the JVM and by Python; a session that sets
    the limit itself keeps its own.
    """
    key, usual, own = BATCH
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, own)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="akin-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "akin_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

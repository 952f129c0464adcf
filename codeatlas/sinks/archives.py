"""Files as gzip tarballs, one per run: what sources.files.archive_entries reads."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame

_TYPES = {"file": tarfile.REGTYPE, "directory": tarfile.DIRTYPE, "symbolic link": tarfile.SYMTYPE, "hard link": tarfile.LNKTYPE}


def _pack(files: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for path, kind, text in files[["path", "type", "text"]].itertuples(index=False):
            entry = tarfile.TarInfo(f"top/{path}")
            entry.type = _TYPES[kind]
            data = (text or "").encode() if kind == "file" else b""
            entry.size = len(data)
            entry.linkname = (text or "") if kind.endswith("link") else ""
            tar.addfile(entry, io.BytesIO(data))
    return out.getvalue()


def tarballs(files: DataFrame) -> DataFrame:
    """(run_id, content) of files (run_id, ord, path, type, text); the text of a link is its target. A run's files are packed by one task, as an archive is one file of bounded size."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": group["run_id"].iloc[:1], "content": [_pack(group.sort_values("ord"))]})

    kind = files.schema["run_id"].dataType.simpleString()
    return files.select("run_id", "ord", "path", "type", "text").groupBy("run_id").applyInPandas(pack, f"run_id {kind}, content binary")

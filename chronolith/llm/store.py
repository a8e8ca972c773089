"""Files of arrays in the shared folder, written once by a task and memory-mapped by the tasks that read them."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np

_ALIGN = 64


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put_arrays(uri: str, arrays: dict[str, np.ndarray], **meta) -> None:
    """Writes the arrays under `uri`; a rename puts the whole file in place, so that a repeated task does no harm."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // _ALIGN) * _ALIGN
    text = json.dumps({"arrays": head, "meta": meta}).encode()
    text = len(text).to_bytes(8, "little") + text
    data = [text.ljust(-(-len(text) // _ALIGN) * _ALIGN, b"\0")]
    for x in arrays.values():
        raw = x.tobytes()
        data.append(raw.ljust(-(-len(raw) // _ALIGN) * _ALIGN, b"\0"))
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            for x in data:
                out.write(x)
        system.move(part, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.writelines(data)
    os.replace(part, path)


def get_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays, memory-mapped where the folder is mounted and else read, and the meta values."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            data = np.frombuffer(source.read(), np.uint8)
    else:
        data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    base = -(-(8 + size) // _ALIGN) * _ALIGN
    out = {}
    for name, (kind, n, at) in head["arrays"].items():
        width = np.dtype(kind).itemsize
        out[name] = data[base + at : base + at + n * width].view(kind)
    return out, head["meta"]

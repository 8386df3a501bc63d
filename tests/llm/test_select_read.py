import zlib

import numpy as np

from quillspark.llm import token_store


def test_files_are_read_by_select(monkeypatch):
    def table(self):
        raise AssertionError("all ends at once")

    monkeypatch.setattr(token_store.EliasFano, "all", table)
    monkeypatch.setattr(token_store, "READ_DOCS", 3)
    arrays = [np.arange(n, dtype="<u2") for n in (4, 1, 700, 1, 9, 33, 2)]
    names = [None, 2, 4, 5, 6, 7, (1 << 60) + 1]  # in rising order, as files have them
    tables = list(token_store._file_rows(token_store.pack_file(names, arrays, np.dtype("<u2")), 100))
    assert [len(t) for t in tables] == [3, 3, 1]
    start, want = 100, []
    for i, a in zip(names, arrays):
        want.append((i, start, len(a), zlib.crc32(a.astype("<u4").tobytes())))
        start += len(a)
    got = [(None if r.id is token_store.pd.NA else r.id, r.start, r.n_tokens, r.ids_crc32) for t in tables for r in t.itertuples()]
    assert got == want

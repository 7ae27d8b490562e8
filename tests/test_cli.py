import json

import pytest

from dossierkit.__main__ import main
from dossierkit.config import load


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('store = "a"\nchunk_bytes = 100\nchunk_overlap = 10\ntext_in_raw = false\n')
    c = load(str(f), {"DOSSIERKIT_CHUNK_BYTES": "200", "DOSSIERKIT_OTHER": "x"}, store="b")
    assert (c.store, c.chunk_bytes, c.chunk_overlap, c.text_in_raw, c.fanout) == ("b", 200, 10, False, 4)
    with pytest.raises(ValueError):
        load(None, {}, chunk_overlap=4000)
    f.write_text("nothing = 1\n")
    with pytest.raises(ValueError):
        load(str(f), {})


def test_commands(spark, tmp_path):
    pages, objects, store = tmp_path / "in", tmp_path / "objects", tmp_path / "store"
    pages.mkdir()

    def page(n, *ids, at="2026-01-01"):
        rows = [{"id": i, "ti": f"t {n}", "ddmudate": [at], "artifact": [json.dumps([{"name": f"{i}.ocr", "mediaType": "text/plain", "size": 4, "md5": "m"}])]} for i in ids]
        (pages / f"{n}.jsonl").write_text("\n".join(map(json.dumps, rows)))

    page(0, "aaaa1", "bbbb2")
    p = objects / "artifacts/a/a/a/a/aaaa1/aaaa1.ocr"
    p.parent.mkdir(parents=True)
    p.write_bytes(b"text of a")
    base = ["--store", str(store), "--source", str(pages), "--objects", str(objects)]
    out = main([*base, "ingest", "--full-text", "--store-raw"], spark)
    assert out["built"] == 2 and out["full_text"] == {"documents": 1, "chunks": 1, "missing": 1} and out["raw"]["stored"] == 1
    page(1, "cccc3", at="2026-02-01")
    assert main([*base, "ingest", "--dry-run"], spark) == {"unchanged": 2, "new": 1}
    assert main([*base, "ingest"], spark)["applied"]["new"] == 1
    assert main([*base, "ingest", "--sample-doc", "--since", "2026-02-01"], spark)["sample"]["id"] == "cccc3"
    got = main([*base, "stats"], spark)
    assert (got["documents"], got["artifacts"], got["text_real_count"], got["raw_logical_count"]) == ("3", "3", "1", "0")

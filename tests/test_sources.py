"""Archives and anchors in pages."""

import io
import tarfile
import zipfile

import pytest
from quillgraph.operators import injection
from quillgraph.sources import archives

PAGE = "<p data-id='p-1'>SUPG uses <b>ta</b>u &amp; <math data-id='m-1'>tau</math> tau.</p><script>tau</script>"


def test_injection_splits_skips_and_repeats():
    occ = [("o1", "e", "p-1", 0, 4, "SUPG"), ("o2", "t", "p-1", 10, 13, "tau"), ("o3", "t", "p-1", 1, 3, "UP"), ("o4", "t", "x", 0, 1, "S"), ("o5", "t", "p-1", 4, 6, "zz"), ("o6", "t", "p-1", 17, 20, "tau")]
    new, told = injection.inject_page(PAGE, occ)
    assert dict(told) == {"o1": "injected", "o2": "injected", "o3": "overlapping", "o4": "missing node", "o5": "stale", "o6": "injected"}
    assert new.count('data-occurrence-id="o2"') == 2 and "<math data-id='m-1'>tau</math>" in new and "&amp;" in new
    again, told = injection.inject_page(new, occ[:2])
    assert again == new and {t for _, t in told} == {"present"}


def test_injection_and_removal_over_tables(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "paper_id long, html string")
    occ = spark.createDataFrame([(1, "o1", "e", "p-1", 0, 4, "SUPG"), (1, "o2", "t", "p-1", 10, 13, "tau")], "paper_id long, id string, entity_id string, node string, start long, end long, text string")
    new = injection.inject(pages, occ)
    got = {r["paper_id"]: (r["injected"], r["skipped"]) for r in new.collect()}
    assert got == {1: (2, 0), 2: (0, 0)}
    gone = injection.remove(new, "t").where("paper_id = 1").first()
    assert gone["removed"] == 2 and "o2" not in gone["html"] and "o1" in gone["html"]
    assert injection.remove(injection.remove(new, "t"), "e").where("paper_id = 1").first()["html"] == PAGE


def test_archives(spark, tmp_path):
    def tar(path, files):
        with tarfile.open(path, "w:gz") as t:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    tar(tmp_path / "a.tar.gz", [("x/notes.tex", b"n"), ("x/main.tex", b"\\documentclass{a}\\begin{document}"), ("../evil.tex", b"e"), ("fig.png", b"p")])
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.tex", "1")
        z.writestr("two.tex", "2")
    (tmp_path / "c.tex").write_text("lone")
    found = archives.read_members(spark, str(tmp_path)).cache()
    assert found.count() == 6 and found.where("member like '%evil%'").count() == 0
    best = {r["archive"].rsplit("/", 1)[1]: r["member"] for r in archives.main_files(found).collect()}
    assert best == {"a.tar.gz": "x/main.tex", "b.zip": "one.tex", "c.tex": "c.tex"}
    with pytest.raises(ValueError):
        archives.members("a.doc", b"")

import io
import json
import zipfile

import pytest

from tidemark.sources import landed


def docx(paragraphs, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:document>")
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_boards(spark, tmp_path):
    gh = {"jobs": [{"id": 7, "title": "ML Engineer", "location": {"name": "Remote, UK"}, "content": "<p>PyTorch</p>", "absolute_url": "u1"}, {"id": None, "title": "Cook", "content": "x" * 9000, "absolute_url": "u2"}]}
    (tmp_path / "acme.json").write_text(json.dumps(gh))
    (tmp_path / "bad.json").write_text("not json")
    rows = {r.url: r for r in landed.greenhouse(landed.landed(spark, str(tmp_path))).collect()}
    assert rows["u1"].job_id == "gh_7" and rows["u1"].company == "acme" and rows["u1"].work_model == "remote" and rows["u1"].description.strip() == "PyTorch"
    assert rows["u2"].job_id.startswith("gh_") and len(rows["u2"].description) == 8000
    lever = spark.createDataFrame([("b", json.dumps([{"id": "z", "text": "Data Scientist", "workplaceType": "Hybrid", "descriptionPlain": "d", "hostedUrl": "u"}]))], "board string, payload string")
    ashby = spark.createDataFrame([("c", json.dumps({"jobs": [{"id": "y", "title": "LLM dev", "descriptionHtml": "<b>x</b>", "jobUrl": "v"}]}))], "board string, payload string")
    every = landed.fan_in([landed.lever(lever), landed.ashby(ashby), landed.greenhouse(landed.landed(spark, str(tmp_path)))])
    assert {r.job_id for r in landed.ai_roles(every).collect()} == {"lv_z", "ab_y", "gh_7"}


def test_pages(spark):
    html = '<a href="/jobs/1">Machine Learning lead</a><a href="/jobs/1">ML engineer two</a><a href="x">no</a><script type="application/ld+json">[{"@type":"JobPosting","title":"NLP dev","description":"<p>d</p>","url":"u"}]</script>'
    df = spark.createDataFrame([(1, html, "https://a.io/careers"), (2, html.split("<script")[0], "https://b.io/c")], "page_id int, html string, url string")
    got = sorted((r.page_id, r.title, r.url, r.strategy) for r in landed.career_pages(df, "page_id", "html", "url").collect())
    assert got == [(1, "NLP dev", "u", "jsonld"), (2, "Machine Learning lead", "https://b.io/jobs/1", "links")]


def test_names_and_lists(spark):
    df = spark.createDataFrame([("https://x/company/deep-minds?a=1",), ("https://x/",)], "u string")
    assert [r[0] for r in df.select(landed.company_of(df.u)).collect()] == ["Deep Minds", "Unknown Startup"]
    known = spark.createDataFrame([("Acme", 5)], "company string, last_yield int")
    assert [r.company for r in landed.watchlist(known, spark.createDataFrame([("acme",), ("Beta",)], "company string")).collect()] == ["Acme", "Beta"]
    posts = spark.createDataFrame([(1, "A", "B"), (2, "a", "b"), (3, "c", "b")], "n int, title string, company string")
    assert sorted(r.n for r in landed.first_of_copies(posts, [posts.n]).collect()) == [1, 3]
    loaders = {name: (lambda s, n=name: s.createDataFrame([(n,)], "source string")) for name in landed.SOURCES}
    on = landed.collect(spark, loaders, {"reed": [1, 0, 0, 0], "adzuna": [0, 0]}, {"wellfound"})
    assert {r.source for r in on.collect()} == set(landed.SOURCES) - {"reed", "wellfound"}


def test_files(spark, tmp_path):
    cases = {
        b"": "empty_file", b"x" * (6 << 20): "file_too_large", b"hello": "unsupported_file_type", b"%PDF-1.4 /JavaScript": "pdf_dangerous_content", b"%PDF-1.4 /Encrypt": "pdf_encrypted",
        docx(["a"], ["word/vbaProject.bin"]): "docx_macro_detected", b"PK\x03\x04junk": "docx_corrupt",
    }
    for data, reason in cases.items():
        assert landed.scan_bytes(data)[:3:2] == (False, reason)
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * (8 << 20))
    assert landed.scan_bytes(bomb.getvalue())[2] == "docx_zipbomb"
    (tmp_path / "a.docx").write_bytes(docx(["Skills", "Python &amp; SQL"]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hello \\(x\\)) Tj ET\nendstream")
    (tmp_path / "c.txt").write_bytes(b"hello")
    got = {r.path.rsplit("/", 1)[1]: r for r in landed.cv_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].raw_text == "Skills\nPython & SQL" and got["b.pdf"].raw_text == "Hello (x)" and not got["c.txt"].allowed and got["c.txt"].raw_text is None


def test_unpacking_is_bounded():
    import zlib

    bomb = b"%PDF-1.4\nstream\n" + zlib.compress(b"0" * (200 << 20)) + b"\nendstream"
    assert len(bomb) < landed.LARGEST
    with pytest.raises(ValueError, match="too much"):
        landed.pdf_text(bomb)
    good = b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Hello) Tj ET") + b"\nendstream"
    assert landed.pdf_text(good) == "Hello"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", (b"<w:t>" + bytes(range(32, 127)) * 10) * 60_000)
    assert landed.scan_bytes(out.getvalue())[2] == "docx_zipbomb"

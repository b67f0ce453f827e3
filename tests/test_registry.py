"""Files that no reader takes are told apart."""

from lectern.sources import registry


def test_pdf_is_unsupported(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.md").write_text("# A")
    status = {r.path.rsplit("/", 1)[1]: r.status for r in registry.scan(spark, str(tmp_path)).collect()}
    assert status == {"a.pdf": "unsupported", "b.pdf": "rejected", "c.md": "ok"}

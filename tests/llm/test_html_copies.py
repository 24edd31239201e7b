"""Copies of a page without an article are one page to their host."""

from spanframe.llm import htmltext


def test_copies_of_a_page_keep_their_text(spark):
    prose = " ".join(f"word{k}" for k in range(300))
    near = [prose.replace("word150 ", f"other{k} ") for k in range(4)]
    notice = " ".join(f"notice{k}" for k in range(15))
    page = lambda *texts: "<html><body>" + "".join(f"<div>{t}</div>" for t in texts) + "</body></html>"
    texts = {k: [prose] for k in range(5)} | {10 + k: [n] for k, n in enumerate(near)}
    noticed = {20 + k: [notice, " ".join(f"own{k}x{i}" for i in range(40))] for k in range(3)}
    rows = [(k, f"http://host/{k}", page(*t)) for k, t in (texts | noticed).items()]
    rows += [(30 + k, None, page("lone " + prose)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: t[0] for k, t in texts.items()} | {k: t[1] for k, t in noticed.items()} | {30 + k: "lone " + prose for k in range(3)}

"""Links are judged by the whole text around them."""

from noticeflow.plans import registry
from noticeflow.sources import pages


def test_words_far_from_the_start_count(spark, tmp_path):
    filler = "lorem ipsum dolor " * 60
    own = f"<body><main><div><p>{filler}</p><p>Bando for the psychologists <a href='/far'>more</a></p></div></main></body>"
    label = "<body><a href='/own'>The notice</a><p>the</p></body>"
    outside = f"<body>the <div><section><div>{filler * 3}<a href='/stop'>x</a></div></section> the</div></body>"
    short = "<body><main><ul><li><span><a href='/up'>x</a></span></li></ul><p>the</p></main></body>"
    html = [own, label, outside, short, None, "", "<a href='/none'>x</a>", "<body><nav><ul><li><a href='/menu'>the</a></li></ul></nav></body>"]
    docs = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    docs.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.href) for r in registry.QUERIES["context_links"](spark, str(tmp_path)).collect()}
    assert got == {(0, "/far"), (1, "/own"), (3, "/up"), (7, "/menu")}


def test_phrases_may_cross_elements():
    assert [r[1] for r in pages.linked("<div><p>Avviso <a href='/a'>Pubblico</a> &Egrave;!</p></div>", ["pubblico avviso pubblico e"])] == ["/a"]

import random

from outing.sources import pages

PARTS = (
    "<p>", "</p>", "<div itemscope>", '<div itemscope itemtype="https://schema.org/Event">', "</div>", '<b itemprop="name">', "</b>", "Jazz &amp; blues", " a > b ", "&", "&lt", "é", "\n", "<br>",
    '<meta itemprop="startDate" content="2024-01-01">', '<i data-x="1" x itemprop="url" class="">', "</i>", "<nav>", "</nav>", "<!-- <p> -->", "<!-->", "<!doctype html>", "<H1 Title=\"a b\">", "</H1 >",
    '<script type="application/ld+json">{"a": "<b>&amp;"}</script>', "<script>1 < 2</script >", "<script></script>", "<title>", "</title>", "<br/>", "<a href=x>", '<a href="x?a&amp;b">', "<", "</", "<style>", "</style>", "<!-- a", "]]>", "<?x?>",
)


def parsed(page):
    reader = pages._Reader()
    reader.feed(page)
    reader.close()
    return reader


def test_plain_pages_read_as_the_parser_reads_them():
    rng, plain = random.Random(3), 0
    for k in range(20_000):
        page = "".join(rng.choices(PARTS if k % 2 else PARTS[:27], k=rng.randint(0, 12)))
        got, want = pages._read_plain(page), parsed(page)
        plain += got is not None
        if got is not None:
            assert (got.words, got.data, got.items) == (want.words, want.data, want.items), page
    assert plain > 5_000

import time

from tidemark.llm import extract


def test_quoted_values_of_any_length():
    for q in "\"'":
        for n in (1_000, 65_535, 65_537, 100_000, 3_000_000):
            page = f"<article class={q}story {'x' * n}{q}><p>Before</p><p><img alt={q}a > b{q} src={q}data:image/png;base64,{'A' * n}{q}>After it</p></article>"
            got = extract.blocks(page)
            assert [(t, tag) for t, _, tag, _ in got] == [("Before", "p"), ("After it", "p")]
            assert all(".story" in own for _, own, _, _ in got)


def test_article_with_a_data_uri():
    model = extract.train()
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A title of it</h1><p>The first part of the story was long and it was told.</p>{}<p>The last part of the story came later, and it ended.</p></article></body></html>"
    plain, with_image = model.texts([page.format('<img src="data:,">'), page.format(f'<img src="data:image/png;base64,{"iVBOR" * 20_000}">')])
    assert "first part" in plain and plain == with_image


def test_tag_like_raw_text_does_not_swallow_its_end():
    page = '<p>One</p><script>if (a <b && c) x = "it\'s <p";</script><p>Two</p><!-- <i " --><p>Three</p>'
    assert [b[0] for b in extract.blocks(page)] == ["One", "Two", "Three"]


def test_unclosed_quotes_stay_linear():
    def seconds(n):
        at = time.process_time()
        assert extract.blocks("<p>x</p>" + "<b>y</b>" * n + "<a href=\"<a title='" + "<i>z " * n)[0][0] == "x"
        return time.process_time() - at

    seconds(1_000)
    assert seconds(160_000) < 16 * max(seconds(40_000), 0.02)

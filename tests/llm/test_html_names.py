"""Names and shapes of page parts that are no article, and the tree scoring against a plain recomputation on random trees."""

import random

import pytest

from siloway.llm import html_text
from siloway.llm.html_text import main_text

P = "<p>" + "This is a real paragraph of the article, with commas, and enough words to count as text for any reader. " * 3 + "</p>"
NOISE = "Something that is not the article at all here."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div id=content>{}</div>"])
@pytest.mark.parametrize(
    "name", "user-comments fb-comments blog-comment readers-comments cookie-law-info-bar onetrust-banner google-ad newsletter-cta mailchimp-signup c-cookie-banner comments-area".split()
)
def test_one_word_of_a_name_is_enough(wrap, name):
    text = main_text(f"<body>{wrap.format(P * 4 + f'<div class={name}><p>{NOISE}</p></div>')}</body>")
    assert NOISE not in text and text.count("real paragraph") == 12


@pytest.mark.parametrize(
    "part",
    [
        '<section id="cookies"><h2>Cookies</h2><p>They are small files, kept by browsers.</p></section>', '<section id="social-effects"><h2>Social effects</h2><p>They are small files.</p></section>',
        f'<div class="cookie-recipe">{P * 9}<p>They are small files.</p></div>', '<h2 id="share-of-comments">They are small files</h2>', '<p class="ad-hoc">They are small files.</p>',
    ],
)
def test_text_and_headings_speak_against_a_name(part):
    assert "They are small files" in main_text(f"<body><article>{P * 4}{part}</article></body>")


def test_comments_by_heading_and_by_shape():
    one = "<div><span class=wpd-author>Ann</span><time>1 May</time><p>I like it, really, a lot of it indeed.</p></div>"
    assert "I like it" not in main_text(f"<body><article>{P * 4}<div class=wpd-thread>{one * 3}</div></article></body>")
    listed = "<section><h2>Comments (3)</h2><ol><li><p>I like it, and so on.</p></li><li><p>Me too.</p></li></ol></section>"
    assert main_text(f"<body><main><article>{P * 4}</article>{listed}</main></body>") == main_text(f"<body><article>{P * 4}</article></body>")
    text = main_text(f"<body><article>{P * 2}<h2>Comments</h2><ul><li>I like it</li></ul><h2>More</h2>{P}</article></body>")
    assert "I like it" not in text and "More" in text and text.count("real paragraph") == 9


def test_labels_of_forms_and_of_adverts():
    text = main_text(f'<body><article>{P * 3}<div aria-label="Advertisement"><p>Buy now.</p></div><fieldset><legend>Vote</legend><label>Yes</label></fieldset></article></body>')
    assert "Buy now" not in text and "Vote" not in text and "Yes" not in text


# --- scoring on random trees ---------------------------------------------------------------------------------------


def random_page(rng):
    def part(depth):
        tag = rng.choice("div section article p p p li ul blockquote h2 td a span".split())
        kids = [part(depth + 1) if depth < 5 and rng.random() < 0.6 else " ".join(rng.choice(["one", "two,", "three", "four"]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 4))]
        return f"<{tag}>{' '.join(kids)}</{tag}>"

    return "<body>" + "".join(part(0) for _ in range(rng.randrange(2, 6))) + "</body>"


def plain_facts(node):
    """(length, linked length, commas, whether it has blocks) of an element by walking all of it."""
    length = linked = commas = 0
    blocks = False
    for kid in node.kids:
        if isinstance(kid, str):
            length += len(kid.strip())
            commas += kid.count(",")
        elif not kid.out:
            n, m, c, b = plain_facts(kid)
            length, linked, commas, blocks = length + n, linked + m, commas + c, blocks or b or kid.tag in html_text.BLOCK
    return length, length if node.tag == "a" else linked, commas, blocks


def test_scores_equal_a_plain_recomputation():
    rng = random.Random(7)
    for _ in range(60):
        nodes = html_text.parse(random_page(rng))
        html_text.leave_out(nodes)
        got = {k: n.points for k, n in html_text.score(nodes).items()}
        want = {}
        for node in nodes:
            length, linked, commas, blocks = plain_facts(node)
            if node.out or not length:
                continue
            loose = blocks and any(isinstance(k, str) and len(k.strip()) >= 25 for k in node.kids)
            paragraph = node.tag in html_text.BLOCK and not blocks and node.tag not in html_text.HEADINGS
            if not paragraph and not loose:
                continue
            points = (1 + commas + min(length / 100, 3)) * (1 - linked / length) if paragraph else 1.0
            up = node.parent if paragraph else node
            for level in range(html_text.LEVELS):
                if up is None:
                    break
                want[id(up)] = want.get(id(up), html_text.CONTAINER_POINTS.get(up.tag, 0)) + points / (1, 2, 6, 9, 12)[level]
                up = up.parent
        assert got == pytest.approx(want)
        best = max(want, key=lambda k: want[k] * (1 - (lambda f: f[1] / f[0] if f[0] else 0)(plain_facts(next(n for n in nodes if id(n) == k))))) if want else None
        chosen = html_text.choose(nodes)
        if best:
            ups, at = set(), next(n for n in nodes if id(n) == best)
            while at is not None:
                ups.add(id(at))
                at = at.parent
            assert any(id(n) in ups for n in chosen)  # the best container or the article around it is among what is taken

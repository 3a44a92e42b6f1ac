"""Generated pages with labelled main text, to train the block labeller on."""

from __future__ import annotations

import numpy as np

MARK = "​"
_SYLLABLES = "the and on er th re an in tion ed wh es or eau que le ment é oi der sch ung ein los que ción ra ar os el i a e o".split()
_MENU = "Home About Contact News Login Register Search Archive Topics Help Shop Profile Start Kontakt Accueil Inicio Menu Imprint Privacy".split()


def _word(rng: np.random.Generator) -> str:
    return "".join(rng.choice(_SYLLABLES, rng.integers(1, 5)))


def _words(rng: np.random.Generator, n: int) -> str:
    pool = [_word(rng) for _ in range(min(n, 24))]
    return " ".join(pool[i] for i in rng.integers(0, len(pool), n))


def _sentences(rng: np.random.Generator, n: int) -> str:
    return " ".join(_words(rng, int(rng.integers(2, 18))).capitalize() + rng.choice([".", ".", ".", "!", "?", "&amp;"]) for _ in range(n))


def _named(rng: np.random.Generator, tags: str, names: str) -> tuple[str, str]:
    tag = rng.choice(tags.split())
    kind = rng.choice(["class", "class", "id"])
    name = rng.choice(names.split())
    if rng.random() < 0.25:
        name += rng.choice(["-box", "-area", "-wrap", " clearfix", "-1", "_main", "-inner"])
    return f'<{tag} {kind}="{name}">', f"</{tag}>"


def _bare(rng: np.random.Generator, tag: str, names: str, plain: float = 0.5) -> tuple[str, str]:
    return (f"<{tag}>", f"</{tag}>") if rng.random() < plain else _named(rng, tag, names)


def _links(rng: np.random.Generator, n: int) -> str:
    def one() -> str:
        return str(rng.choice(_MENU)) if rng.random() < 0.4 else _words(rng, int(rng.integers(1, 4)))

    if rng.random() < 0.8:
        return "<ul>" + "".join(f'<li><a href="/{i}">{one()}</a></li>' for i in range(n)) + "</ul>"
    return " | ".join(f'<a href="/{i}">{one()}</a>' for i in range(n))


def _short(rng: np.random.Generator) -> str:
    """Boilerplate of any kind: a few words up to some sentences."""
    text = _sentences(rng, int(rng.integers(1, 4)))
    return rng.choice([text, f"<p>{text}</p>", f"<h3>{_words(rng, 2)}</h3><p>{text}</p>", f"<span>{text}</span> <a href='#'>{_words(rng, 2)}</a>"])


def _around(rng: np.random.Generator) -> str:
    """One element that is not main text."""
    kind = rng.integers(0, 9)
    if kind == 0:
        a, b = _bare(rng, "nav", "menu navigation breadcrumb topnav") if rng.random() < 0.6 else _named(rng, "div ul section", "menu navbar navigation nav breadcrumb topmenu tabs pagination")
        return a + _links(rng, int(rng.integers(2, 10))) + b
    if kind == 1:
        a, b = _bare(rng, "header", "header masthead site-header top") if rng.random() < 0.5 else _named(rng, "div", "header masthead site-header logo banner topbar")
        return a + rng.choice([f"<h1>{_words(rng, 3)}</h1>", f"<p>{_sentences(rng, 1)}</p>", _links(rng, 3)]) + b
    if kind == 2:
        a, b = _bare(rng, "aside", "sidebar related widget") if rng.random() < 0.5 else _named(rng, "div section", "sidebar related widget recommended popular trending more-stories")
        return a + rng.choice([_links(rng, int(rng.integers(2, 8))), _short(rng)]) + b
    if kind == 3:
        a, b = _named(rng, "div section p dialog", "cookie notice consent cookie-notice gdpr alert cookie-banner notification newsletter-popup paywall disclaimer")
        return a + f"{_sentences(rng, int(rng.integers(1, 3)))} <button>OK</button>" + b
    if kind == 4:
        a, b = _named(rng, "div section aside ins", "ad ads advert advertisement sponsored promo banner-ad adsense sponsor")
        return a + _short(rng) + b
    if kind == 5:
        a, b = _bare(rng, "form", "search newsletter login subscribe contact", 0.6)
        return f'{a}<label>{_words(rng, 2)}</label><input type="text"><p>{_sentences(rng, 1)}</p><button>{_words(rng, 1)}</button>{b}'
    if kind == 6:
        a, b = _named(rng, "div section ol ul", "comments comment-list discussion responses disqus reader-comments commentlist replies")
        tag = "li" if a[1] in "ou" else rng.choice(["div", "p", "article"])
        inner = "".join(f'<{tag} class="comment"><b>{_word(rng)}</b> <p>{_sentences(rng, int(rng.integers(1, 5)))}</p></{tag}>' for _ in range(int(rng.integers(1, 6))))
        return a + rng.choice(["", f"<h3>{_words(rng, 2)}</h3>"]) + inner + b
    if kind == 7:
        a, b = _named(rng, "div ul p", "share social social-links follow tags byline author-bio meta print-only hidden toolbar")
        return a + (_links(rng, int(rng.integers(2, 5))) if rng.random() < 0.6 else _sentences(rng, 1)) + b
    return f"<script>var x = '{_words(rng, 3)}';</script><style>p {{ margin: 0 }}</style>"


def _foot(rng: np.random.Generator) -> str:
    a, b = _bare(rng, "footer", "footer site-footer bottom") if rng.random() < 0.6 else _named(rng, "div section", "footer site-footer bottom copyright legal colophon")
    return a + rng.choice([f"&copy; {_word(rng)}.example.com &middot; {_sentences(rng, 1)}", _links(rng, 4), _short(rng)]) + b


def _marked(text: str) -> str:
    return MARK + text


def _main(rng: np.random.Generator) -> str:
    out = [f"<h1>{_marked(_words(rng, int(rng.integers(1, 12))))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(int(rng.integers(1, 22))):
        x = rng.random()
        text = _marked(_sentences(rng, int(rng.integers(1, 9))))
        if x < 0.7:
            out.append(f"<p>{text}" + ("</p>" if rng.random() < 0.9 else ""))
        elif x < 0.78:
            out.append(f"<p><b>{text}<br>")
        elif x < 0.84:
            out.append(f"<h{rng.integers(2, 5)}>{_marked(_words(rng, int(rng.integers(1, 8))))}</h{rng.integers(2, 5)}>")
        elif x < 0.89:
            tag = rng.choice(["ul", "ol"])
            out.append(f"<{tag}>" + "".join(f"<li>{_marked(_words(rng, int(rng.integers(1, 15))))}</li>" for _ in range(int(rng.integers(1, 6)))) + f"</{tag}>")
        elif x < 0.92:
            out.append(f"<blockquote>{rng.choice(['', '<p>'])}{text}</blockquote>")
        elif x < 0.94:
            out.append(f"<pre>{text}</pre>")
        elif x < 0.96:
            out.append("<table>" + "".join(f"<tr><td>{_marked(_words(rng, 2))}</td><td>{_marked(_words(rng, 3))}</td></tr>" for _ in range(3)) + "</table>")
        elif x < 0.98:
            out.append(f'<p>{text} <a href="/x">{_words(rng, 3)}</a> {_words(rng, 4)}.</p>')
        else:
            out.append(f"<div>{text}</div>")
        if rng.random() < 0.06:
            out.append(_around(rng))
    return "".join(out)


def page(rng: np.random.Generator) -> str:
    """A page; each block of its main text holds MARK."""
    if rng.random() < 0.02:
        return _marked(_sentences(rng, int(rng.integers(1, 30))))
    inside = _main(rng)
    a, b = _bare(rng, "article", "post entry article story", 0.7) if rng.random() < 0.6 else _bare(rng, "main", "content main", 0.5) if rng.random() < 0.4 else _named(rng, "div section", "content article main post entry-content article-body story post-content main-content text body-text")
    if rng.random() < 0.15:
        inside += _around(rng)
    inside = a + inside + b
    if rng.random() < 0.3:
        c, d = _bare(rng, "main", "content page", 0.6) if rng.random() < 0.5 else _named(rng, "div", "container wrapper page layout row col content-area site")
        inside = c + "".join(_around(rng) for _ in range(int(rng.integers(0, 2)))) + inside + "".join(_around(rng) for _ in range(int(rng.integers(0, 3)))) + d
    before = "".join(_around(rng) for _ in range(int(rng.integers(0, 4))))
    after = "".join(_around(rng) for _ in range(int(rng.integers(0, 3)))) + (_foot(rng) if rng.random() < 0.8 else "")
    body = before + inside + after
    if rng.random() < 0.9:
        body = f"<body>{body}" + ("</body></html>" if rng.random() < 0.8 else "")
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 4)}</title></head>{body}"

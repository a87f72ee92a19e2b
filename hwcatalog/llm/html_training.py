"""Labelled pages for the content model: made layouts in many styles, each with the texts of its content blocks."""

from __future__ import annotations

import random

_WORDS = "time year people way day man thing world life hand part child eye place work week case point company number group problem fact river stone light north market season letter garden window engine copper signal harbour winter valley question answer story record winding careful silver quiet broken early later often under around between".split()
#: Names that page authors give to parts that aren't content, by kind.
_NAMES = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs site-nav toc pagination pager",
    "header": "header site-header masthead topbar branding page-header logo",
    "footer": "footer site-footer colophon bottom copyright legal",
    "side": "sidebar aside side widget widget-area rail related related-posts recommended popular trending",
    "ad": "ad ads advert advertisement sponsor sponsored banner promo adsbox ad-slot dfp",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal overlay newsletter subscribe paywall message",
    "form": "form search search-form login signup contact-form",
    "share": "share social share-buttons social-links tags meta-links",
    "comments": "comments comment comment-list comment-body reply respond disqus discussion responses",
    "content": "content article post entry entry-content post-content article-body story main text body-text page-content single",
}
NAMES = {k: v.split() for k, v in _NAMES.items()}
#: Roles of such parts (fixed by ARIA).
_ROLES = {"menu": "navigation menu menubar", "header": "banner", "footer": "contentinfo", "side": "complementary", "notice": "dialog alertdialog alert status", "form": "search form", "share": "toolbar group", "content": "main article"}
ROLES = {k: v.split() for k, v in _ROLES.items()}


#: Headings of readers' comments and of other parts.
_COMMENT_HEADS = ["Comments", "Comment", "{} comments", "Responses", "{} responses", "Leave a reply", "Replies", "Discussion", "Reader comments"]
_SIDE_HEADS = ["Related", "Popular", "Recommended", "Trending", "Related stories", "Categories", "Newsletter", "Sponsored"]
#: Headings of an article's sections with words of those.
_TOPICS = ["Discussion", "Related work", "Responses", "Popular culture", "Discussion and comments", "Newsletter", "Categories", "Trending topics", "Recommended reading", "Replies"]
_FOOTERS = ["Copyright {} {}", "&copy; {} {}", "Copyright {} {}. All rights reserved.", "&copy; {} {} &middot; Privacy &middot; Terms", "All rights reserved."]


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    """``n`` pages as (html, texts of content blocks), the same for the same seed."""
    rng = random.Random(seed)
    return [_plain(rng) if rng.random() < 0.25 else _page(rng) for _ in range(n)]


def _sentence(rng: random.Random, low: int = 3, high: int = 18) -> str:
    words = [rng.choice(_WORDS) + rng.choice(["", "", "", "s", "ing"]) for _ in range(rng.randint(low, high))]
    if len(words) > 6 and rng.random() < 0.6:
        words[rng.randrange(2, 5)] += ","
    return " ".join(words).capitalize() + "."


def _prose(rng: random.Random) -> str:
    text = " ".join(_sentence(rng, *rng.choice([(1, 2), (3, 18), (5, 25)])) for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))
    return text.rstrip(".") if rng.random() < 0.25 else text


def _label(rng: random.Random, kind: str) -> str:
    r = rng.random()
    if r < 0.1:
        return ""
    if r < 0.35 and kind in ROLES:
        return f' role="{rng.choice(ROLES[kind])}"'
    names = " ".join(rng.sample(NAMES[kind], rng.choice([1, 1, 2])))
    if r < 0.42 and kind != "content":
        return f' aria-label="{names}"'
    return f' {rng.choice(["class", "class", "class", "id"])}="{names}"'


def _links(rng: random.Random) -> str:
    items = [f'<a href="/{rng.choice(_WORDS)}">{rng.choice([rng.choice(_WORDS).capitalize(), _sentence(rng, 2, 5)])}</a>' for _ in range(rng.randint(2, 9))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else rng.choice([" ", " | "]).join(items)


def _junk(rng: random.Random, kind: str) -> str:
    """A part of a page that isn't its article."""
    a = _label(rng, kind)
    say = lambda: rng.choice([_sentence(rng, 2, 8), _sentence(rng), _prose(rng)])
    wrap = lambda t: rng.choice([t, f"<p>{t}</p>", f"<div>{t}</div>"])
    if kind == "menu":
        tag = rng.choice(["nav", "nav", "nav", "div", "ul"])
        return f"<{tag}{a}>{_links(rng)}</{tag}>" if tag != "ul" else f"<div{a or ' class=menu'}>{_links(rng)}</div>"
    if kind == "header":
        return rng.choice([f"<header{a}>{rng.choice(['', '<h1>' + _sentence(rng, 1, 4) + '</h1>', wrap(say())])}{_links(rng) if rng.random() < 0.6 else ''}{wrap(_sentence(rng, 1, 4))}</header>", f"<div{a or ' class=header'}>{wrap(_sentence(rng, 1, 5))}</div>"])
    if kind == "footer" and rng.random() < 0.3:
        return f"<{(tag := rng.choice(['footer', 'div', 'p', 'div']))}>{wrap(_owner(rng)) if tag != 'p' else _owner(rng)}</{tag}>"
    if kind == "footer":
        return rng.choice([f"<footer{a}>{wrap('&copy; ' + rng.choice(_WORDS) + '.example.com &middot; ' + say())}{_links(rng) if rng.random() < 0.4 else ''}</footer>", f"<div{a or ' class=footer'}>{wrap('&copy; ' + say())}</div>"])
    if kind == "side":
        body = "".join(f"<div>{rng.choice(['', '<h3>' + _sentence(rng, 1, 4) + '</h3>'])}{rng.choice([_links(rng), wrap(say())])}</div>" for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside{a}>{body}</aside>", f"<aside{a}>{wrap(say())}</aside>", f"<div{a or ' class=sidebar'}>{body}</div>"])
    if kind == "form":
        return f'<form{a} action="/x">{wrap(say())}<label>{_sentence(rng, 1, 3)}</label><input name="q"><button>{rng.choice(_WORDS)}</button></form>'
    if kind == "comments" and rng.random() < 0.3:
        return _reader_comments(rng)
    if kind == "comments":
        one = lambda: rng.choice([f"<article{_label(rng, 'comments')}><p>{say()}</p></article>", f"<li{_label(rng, 'comments')}><p>{say()}</p></li>", f"<div{_label(rng, 'comments')}><h4>{rng.choice(_WORDS)}</h4><p>{say()}</p></div>", f"<p>{say()}</p>"])
        tag = rng.choice(["section", "div", "div", "ol"])
        return f"<{tag}{a or ' class=comments'}>{rng.choice(['', '<h2>' + _sentence(rng, 1, 3) + '</h2>', '<h3>Comments</h3>'])}{''.join(one() for _ in range(rng.randint(1, 5)))}</{tag}>"
    if kind == "notice" and rng.random() < 0.2:
        return f"<dialog open>{wrap(say())}<button>{rng.choice(_WORDS)}</button></dialog>"
    if kind == "share" and rng.random() < 0.4:
        return rng.choice([f"<button>{_sentence(rng, 1, 2)}</button>", f"<label>{_sentence(rng, 1, 3)}</label>", f"<button{a}>{rng.choice(_WORDS)}</button><label>{rng.choice(_WORDS)}</label>"])
    if kind == "ad" and rng.random() < 0.1:
        return rng.choice([f"<noscript>{wrap(say())}</noscript>", f"<svg><text>{_sentence(rng, 1, 3)}</text></svg>", f"<object>{say()}</object>"])
    tag = rng.choice(["div", "div", "section", "aside", "p"] if kind != "share" else ["div", "ul", "p"])
    return f"<{tag}{a or f' class={NAMES[kind][0]}'}>{say() if tag in ('p', 'ul') else wrap(say())}</{tag}>" if kind != "share" else f"<div{a or ' class=share'}>{_links(rng)}</div>"


def _owner(rng: random.Random) -> str:
    return rng.choice(_FOOTERS).format(rng.randint(1995, 2026), rng.choice(_WORDS).capitalize())


def _reader_comments(rng: random.Random) -> str:
    """Readers' comments that only a heading tells."""
    say = lambda: rng.choice([_sentence(rng, 2, 8), _sentence(rng), _prose(rng)])
    h = rng.choice(["h2", "h2", "h3", "h3", "h4"])
    head = f"<{h}>{rng.choice(_COMMENT_HEADS).format(rng.randint(1, 99))}</{h}>"
    one, many = rng.choice([("<li>{}</li>", "<ol>{}</ol>"), ("<li><p>{}</p></li>", "<ul>{}</ul>"), ("<article><p>{}</p></article>", "{}"), ("<div><b>{name}</b> {}</div>", "{}"), ("<p>{}</p>", "<div>{}</div>"), ("<div><h5>{name}</h5><p>{}</p></div>", "{}")])
    body = many.format("".join(one.format(say(), name=rng.choice(_WORDS).capitalize()) for _ in range(rng.randint(1, 5))))
    tag = rng.choice(["section", "section", "div", ""])
    return f"<{tag}>{head}{body}</{tag}>" if tag else head + body


def _plain(rng: random.Random) -> tuple[str, set[str]]:
    """Pages without names and with few telling tags: text alone, plain blocks, layout tables."""
    good: set[str] = set()

    def keep(text: str) -> str:
        good.add(text)
        return text

    long_ = lambda: keep(" ".join(_sentence(rng, 8, 22) for _ in range(rng.choice([1, 1, 2, 4, 8]))))
    r = rng.random()
    if r < 0.15:  # a text without any block
        text = keep(rng.choice([long_, lambda: _prose(rng), lambda: _sentence(rng, 1, 6)])())
        return rng.choice(["{}", "<html><body>{}</body></html>", "<body>{}"]).format(text), good
    form = rng.choice(["<div>{}</div>", "<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>", "<p>{}"])
    head = rng.choice(["", "", f"<h1>{keep(_sentence(rng, 1, 6).rstrip('.'))}</h1>"])
    blocks = head + "".join(form.format(long_() if rng.random() < 0.8 else keep(_prose(rng))) for _ in range(rng.choice([1, 2, 2, 3, 5, 8])))
    menu = "".join(rng.choice(["<a href='/{0}'>{1}</a> ", "<a href='/{0}'>{1}</a><br>"]).format(x, x.capitalize()) for x in rng.sample(_WORDS, rng.randint(2, 6)))
    foot = _owner(rng)
    if r < 0.4:  # a layout table
        top = rng.choice(["", f"<tr><td colspan=2>{_sentence(rng, 1, 3).rstrip('.')}</td></tr>"])
        end = rng.choice(["", f"<tr><td colspan=2>{foot}</td></tr>"])
        cells = [f"<td>{rng.choice([menu, _links(rng)])}</td>", f"<td>{long_() if rng.random() < 0.3 else blocks}</td>"]
        if rng.random() < 0.25:
            cells.reverse()
        body = f"<table>{top}<tr>{''.join(cells)}</tr>{end}</table>"
    else:
        if rng.random() < 0.5:
            blocks = f"<div>{blocks}</div>"
        before = rng.choice(["", "", f"<div>{menu}</div>", _links(rng), f"<nav>{_links(rng)}</nav>"])
        side = rng.choice(["", "", "", f"<div><h3>{rng.choice(_SIDE_HEADS)}</h3>{_links(rng)}</div>"])
        notes = _reader_comments(rng) if rng.random() < 0.35 else ""
        end = rng.choice(["", f"<div>{foot}</div>", f"<p>{foot}</p>", f"<footer>{foot}</footer>", f"<hr>{foot}"])
        body = f"{before}{blocks}{notes}{side}{end}"
        if rng.random() < 0.3:
            body = f"<div>{body}</div>"
    return rng.choice([f"<html><body>{body}</body></html>", body]), good


def _article(rng: random.Random, good: set[str]) -> str:
    """Content blocks, with unclosed tags and short blocks as real pages have them."""

    def keep(text: str) -> str:
        good.add(text)
        return text

    out = []
    if rng.random() < 0.85:
        out.append(f"<h1>{keep(_sentence(rng, 1, 9).rstrip('.' * rng.randint(0, 1)))}</h1>")
        if rng.random() < 0.15:
            out[-1] = f"<header>{out[-1]}</header>"
    linked = rng.random() < 0.1  # an article of links
    for _ in range(rng.choice([0, 1, 2, 2, 4, 8, 14])):
        r = 0.55 + rng.random() * 0.15 if linked else rng.random()
        if r < 0.55:
            text = rng.choice([_prose, _prose, lambda g: _sentence(g, 1, 2)])(rng)
            form = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{} </p>\n"])
            out.append(form.format(keep(text)))
        elif r < 0.66:  # links in the text, or a text that is a link
            text = rng.choice([_prose, _prose, lambda g: _sentence(g, 1, 5)])(rng)
            words = text.split(" ")
            i = rng.choice([0, rng.randrange(len(words))])
            j = rng.choice([len(words), rng.randrange(i, len(words)) + 1])
            linked = " ".join(words[i:j])
            out.append(f"<p>{' '.join(words[:i])}{' ' * (i > 0)}<a href='/{i}'>{linked}</a>{' ' * (j < len(words))}{' '.join(words[j:])}</p>")
            keep(text)
        elif r < 0.7:  # a list of linked sources
            items = [rng.choice([_sentence(rng, 2, 9), _sentence(rng, 1, 3).rstrip(".")]) for _ in range(rng.randint(1, 6))]
            tag = rng.choice(["ul", "ol"])
            out.append(rng.choice(["", f"<h2>{keep(_sentence(rng, 1, 2).rstrip('.'))}</h2>"]) + f"<{tag}>" + "".join(f"<li><a href='/s'>{keep(x)}</a></li>" for x in items) + f"</{tag}>")
        elif r < 0.78:
            out.append(f"<h2>{keep(rng.choice(_TOPICS) if rng.random() < 0.12 else _sentence(rng, 1, 6))}</h2>")
        elif r < 0.86:
            out.append("<ul>" + "".join(f"<li>{keep(_sentence(rng))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif r < 0.9:
            out.append(f"<blockquote><p>{keep(_prose(rng))}</p></blockquote>")
        elif r < 0.93:
            out.append(f"<figure><img src=x><figcaption>{keep(_sentence(rng))}</figcaption></figure>")
        elif r < 0.96:
            cell = lambda: keep(rng.choice([_sentence(rng, 1, 3), rng.choice(_WORDS), str(rng.randint(1, 9999))]))
            top = "<tr>" + "".join(f"<th>{cell()}</th>" for _ in range(3)) + "</tr>" if rng.random() < 0.6 else ""
            rows = "".join("<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 3)))
            out.append(rng.choice([f"<table>{top}{rows}</table>", f"<table><thead>{top}</thead><tbody>{rows}</tbody></table>"]))
        elif r < 0.98:
            out.append(rng.choice([f"<pre>{keep(rng.choice(_WORDS) + ' = ' + str(rng.randint(1, 99)))}</pre>", f"<dl><dt>{keep(rng.choice(_WORDS))}</dt><dd>{keep(_sentence(rng))}</dd></dl>", f"<h3>{keep(_sentence(rng, 1, 5).rstrip('.'))}</h3>", f"<section><h2>{keep(_sentence(rng, 1, 5))}</h2><p>{keep(_prose(rng))}</p></section>"]))
        else:
            out.append(f"<div>{keep(_prose(rng))}</div>")
        if rng.random() < 0.08:
            out.append(_junk(rng, rng.choice(["ad", "side", "share", "share", "notice", "form", "menu"])))
    return "".join(out)


def _page(rng: random.Random) -> tuple[str, set[str]]:
    good: set[str] = set()
    tag = rng.choice(["article"] * 12 + ["main"] * 3 + ["div"] * 4 + ["section"] * 2 + [""])
    named = _label(rng, "content") if tag in ("div", "section") or tag and rng.random() < 0.4 else ""
    body = f"<{tag}{named or (' class=content' if tag in ('div', 'section') else '')}>{_article(rng, good)}"
    if rng.random() < 0.1:
        body += _junk(rng, rng.choice(["comments", "share", "side"]))
    body += f"</{tag}>"
    body = body.replace("<>", "").replace("</>", "")
    before = [_junk(rng, k) for k in ("notice", "header", "menu", "ad", "form", "side") if rng.random() < {"menu": 0.8, "ad": 0.5}.get(k, 0.3)]
    after = [_junk(rng, k) for k in ("share", "comments", "side", "ad", "form", "notice", "footer") if rng.random() < {"footer": 0.8, "comments": 0.4}.get(k, 0.25)]
    if rng.random() < 0.3:
        rng.shuffle(before)
        body = f"<div{rng.choice(['', ' id=wrap', ' class=container', ' id=page'])}>{body}{after.pop(0) if after and rng.random() < 0.5 else ''}</div>"
    if rng.random() < 0.2 and tag != "main":
        body = f"<main>{body}</main>"
    head = "<head><title>x</title></head>" if rng.random() < 0.5 else ""
    text = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{body}{''.join(after)}</body></html>"
    return text, good

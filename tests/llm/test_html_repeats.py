"""What structure leaves undecided, the host's repeats decide: by brute force, beside teasers, and for words that name two things."""

import random

from spanframe.llm import htmltext

SCHEMA = "page_id long, url string, html string"


def wanted(pages, tokens, least):
    """Text of each page {id: (host, [(own, words)])}, all substrings held against all pages of the host."""
    streams = {}
    for k, (_, cut) in pages.items():
        streams[k] = [[]]
        for own, words in cut:
            if own:
                streams[k].append([])
            else:
                streams[k][-1] += words
    mixed = {k: any(own for own, _ in cut) for k, (_, cut) in pages.items()}

    def repeats(k, words, whole):
        held = 0
        for j in pages:
            if pages[j][0] == pages[k][0]:
                blocks = [w for own, w in pages[j][1] if mixed[j] and not own]
                held += words in blocks if whole else any(s[i : i + len(words)] == words for s in streams[j] for i in range(len(s)))
        return held >= least

    out = {}
    for k, (_, cut) in pages.items():
        stay = []
        for words in streams[k]:
            keep = [True] * len(words)
            for length in range(tokens, len(words) + 1):
                for i in range(len(words) - length + 1):
                    if any(keep[i : i + length]) and repeats(k, words[i : i + length], False):
                        keep[i : i + length] = [False] * length
            stay += keep
        left, at = [], 0
        for own, words in cut:
            if own:
                left += words
            else:
                short = len(words) < tokens and mixed[k] and repeats(k, words, True)
                left += [w for w, s in zip(words, stay[at : at + len(words)]) if s and not short]
                at += len(words)
        out[k] = " ".join(left)
    return out


def test_repeats_by_brute_force(spark):
    rng = random.Random(1)
    pieces = [[f"r{k}x{i}" for i in range(rng.randrange(2, 10))] for k in range(6)]
    pages, rows = {}, []
    for k in range(80):
        host, article, cut, html = f"h{k % 5}", k % 2 == 0, [], ""
        own = [f"own{k}x{i}" for i in range(12)]
        for n in range(rng.randrange(3, 7)):
            words = list(rng.choice(pieces)) if rng.random() < 0.7 else [f"p{k}x{n}x{i}" for i in range(rng.randrange(1, 6))]
            if rng.random() < 0.3:
                words = words[rng.randrange(len(words)) :]
            cut.append((False, words))
            html += f"<p{' class=alert' if article else ''}>{' '.join(words)}</p>"
            if article and rng.random() < 0.4:
                cut.append((True, [f"mid{k}x{n}"]))
                html += f"<p>mid{k}x{n}</p>"
        cut.insert(0, (article, own))
        html = f"<p>{' '.join(own)}</p>" + html
        pages[k] = (host, cut)
        rows.append((k, f"http://{host}/{k}", f"<article>{html}</article>" if article else html))
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, SCHEMA), tokens=5).collect()}
    assert got == wanted(pages, 5, 3)
    assert any(len(got[k].split()) < sum(len(w) for _, w in pages[k][1]) for k in pages if k % 2 == 0)


def test_text_beside_a_teaser_and_words_that_name_two_things(spark):
    body = lambda k: " ".join(f"body{k}x{i}" for i in range(60))
    nag = "please log in to read on"
    page = lambda k: (
        f"<nav>menu</nav><article><h2>Teaser {k}</h2></article><div>{body(k)}</div><div>{' '.join(f'legal{i}' for i in range(14))}</div><footer>f</footer>"
    )
    inside = lambda k: f"<article><p>{body(k)}</p><p class=alert>{nag}</p><p class='alert'>Storm {k} is near</p><p>a <label>b</label><span class=search>c</span></p><div class=alert>no</div><p class=comment>no</p></article><div>short</div>"
    rows = [(k, f"http://a/{k}", page(k)) for k in range(4)] + [(10 + k, f"http://b/{k}", inside(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"Teaser {k} {body(k)}" for k in range(4)} | {10 + k: f"{body(k)} Storm {k} is near a bc" for k in range(4)}


def test_form_labels_and_drops_stay_out():
    cases = {
        "<article><p>a<form><label>no</label></form></p><label>no</label><p role=alert>no</p><p class='alert ad'>no</p><p hidden class=alert>no</p>b</article>": [(True, "a"), (True, "b")],
        "<article><p class=search>x</p></article>": [(False, "x")], "<main><p>long enough</p></main><div>less</div>": [(True, "long enough")],
    }
    for page, want in cases.items():
        assert htmltext.blocks(page) == want, page

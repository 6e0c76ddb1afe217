import re

import pytest
from sitelens.llm import html_text, queries

BODY = "This is the first paragraph of the article and it says what the article is about, in a few words that everyone knows."


def page(*parts):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


def test_article_of_every_page(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op5_main_text(spark, sf).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text.split("\n\n") == [w for w in want if w] and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "junk",
    [
        '<nav><a href="/a">The home of all the news</a></nav>',
        f'<div class="sidebar"><p>{BODY}</p></div>',
        f'<div id="cookie-notice"><p>{BODY}</p></div>',
        f"<aside><p>{BODY}</p></aside>",
        f'<section class="comments"><article><p>{BODY} So I say.</p></article></section>',
        "<form><label>Your name, and the name of a friend that you have</label><input name=x></form>",
        "<script>if (a < b) { document.write('<p>the and of</p>') }</script>",
        f'<div class="ad-box">{BODY}</div>',
        "<footer>&copy; 2024 The company that made all of this</footer>",
        f"<header><p>{BODY}</p></header>",
        "<!-- <p>the and of</p> -->",
        '<ul class="menu"><li>The one</li><li>The other</li></ul>',
    ],
)
@pytest.mark.parametrize("inner", ["<article><h1>Head</h1><p>{0}</p><p>Short &amp; good.</p></article>", "<div id=content><h1>Head</h1><p>{0}<p>Short &amp; good.</div>"])
def test_what_is_not_the_article_goes(junk, inner):
    want = f"Head\n\n{BODY}\n\nShort & good."
    assert html_text.main_text(page(junk, inner.format(BODY))) == want
    assert html_text.main_text(page(inner.format(BODY), junk)) == want


def test_names_that_only_say_what_a_page_has():
    inner = f'<div class="layout has-sidebar"><article class="post with-comments"><header class="entry-header"><h1>Head</h1></header><p>{BODY}</p><p class="share-box">{BODY}</p></article></div>'
    assert html_text.main_text(page(inner)) == f"Head\n\n{BODY}"
    assert html_text.main_text(page(f"<div><p>{BODY}</p><p hidden>{BODY}</p><div style='display:none'>{BODY}</div></div>")) == BODY


def test_cut_and_unclosed_pages():
    assert html_text.main_text(f"<article><p><b>{BODY}<br><p>Then  \n more &eacute;&#x21;") == f"{BODY}\n\nThen more é!"
    assert html_text.main_text("<a href=\"x>" * 2000 + "<p").startswith("<a") is False
    assert html_text.main_text("") == "" and html_text.main_text("<script>var x") == ""


def test_odd_rows(spark, none):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, page(f"<p>{BODY}</p>" * 3000), 7), (None, "plain text and nothing else", 8)], "page_id long, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got[1] == got[2] == "" and len(got[3].split("\n\n")) == 3000
    assert html_text.extract(rows.limit(0)).collect() == []


@pytest.mark.parametrize("attribute", ['class="overflow-hidden"', 'class="md:hidden"', 'style="overflow:hidden"', 'data-hidden="false"', "aria-hidden=false", 'title="not hidden here"', 'hidden="until-found"', 'data-note="display:none"', "title='aria-hidden=true'"])
@pytest.mark.parametrize("tag", ["div", "section", "main", "article", "p"])
def test_what_is_not_hidden_stays(tag, attribute):
    inside = BODY if tag == "p" else f"<p>{BODY}</p>"
    assert html_text.main_text(page(f"<{tag} {attribute}>{inside}</{tag}>")) == BODY


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", 'class="x" hidden', 'class="x"hidden', 'hidden="hidden"', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"', "style=display:none"])
def test_what_is_hidden_goes(attribute):
    assert html_text.main_text(page(f"<div><p>{BODY}</p><div {attribute}><p>{BODY}</p></div></div>")) == BODY


@pytest.mark.parametrize("tag", ["video", "object", "select", "noscript", "svg", "math", "canvas", "audio", "iframe", "template", "noembed", "noframes"])
def test_a_missing_end_tag_skips_only_the_start_tag(tag):
    assert html_text.main_text(page(f"<article><p>{BODY}</p><{tag} x=1><p>{BODY} Then more.</p></article>")) == f"{BODY}\n\n{BODY} Then more."
    assert html_text.main_text(page(f"<article><p>{BODY}</p><{tag}>gone</{tag}><p>{BODY} Then more.</p></article>")) == f"{BODY}\n\n{BODY} Then more."


OTHER_LANGUAGES = [
    "中国是一个历史悠久的国家，拥有丰富的文化遗产。人们在这里生活和工作已经有几千年了，城市和乡村都在不断变化。今天许多年轻人到城市里寻找工作，也有人回到家乡。",
    "Россия является большой страной, и в ней живут люди разных народов. Каждый год сюда приезжают гости, чтобы увидеть города, реки и леса. Многие из них возвращаются снова.",
    "L'Italia conserva città antiche, e ogni anno milioni di visitatori arrivano dal mondo intero. Molti tornano volentieri, perché trovano sempre qualcosa di nuovo da vedere e da gustare.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
]


@pytest.mark.parametrize("text", OTHER_LANGUAGES)
def test_pages_in_languages_without_stop_words(text):
    menu = "<nav><a href=/a>Menu</a></nav>" + "<ul>" + "".join(f"<li><a href=/{k}>Link {k} to something else</a></li>" for k in range(6)) + "</ul>"
    page = f"<html><body>{menu}<div><p>{text}</p><p>{text[::-1][1:]}{text[-1]}</p></div><footer>{text}</footer></body></html>"
    assert html_text.main_text(page).split("\n\n")[0] == text and html_text.main_text(page).count(text) == 1


def test_a_paragraph_in_another_script_stays():
    english = "This is a paragraph of the text that is long enough to be taken for what it is by all of the rules."
    page = f"<body><div><p>{english}</p><p>{OTHER_LANGUAGES[0]}</p><p>{english} And more.</p></div></body>"
    assert html_text.main_text(page).split("\n\n") == [english, OTHER_LANGUAGES[0], english + " And more."]


NEWS = {
    "it": ("Il governo ha approvato ieri la nuova legge sul lavoro dopo lunghe trattative.", "Le imprese chiedono regole più semplici per assumere giovani."),
    "pt": ("O governo aprovou ontem uma lei que muda as regras do trabalho em todo o país.", "Os sindicatos dizem que vão continuar os protestos na capital."),
    "nl": ("De regering heeft gisteren een wet aangenomen over het werk in de grote steden.", "De vakbonden zeggen dat ze blijven protesteren in de hoofdstad."),
    "ro": ("Guvernul a adoptat ieri o lege nouă despre muncă după negocieri lungi și grele.", "Sindicatele spun că vor continua protestele în capitală."),
    "da": ("Regeringen vedtog i går en ny lov om arbejde efter lange forhandlinger i Folketinget.", "Fagforeningerne siger, at de fortsætter protesterne i hovedstaden."),
    "sv": ("Regeringen antog i går en ny lag om arbete efter långa förhandlingar i riksdagen.", "Facken säger att de fortsätter protestera i huvudstaden."),
    "tr": ("Hükümet dün uzun görüşmelerden sonra çalışma hayatına ilişkin yeni bir yasa kabul etti.", "Sendikalar başkentteki protestoları sürdüreceklerini söylüyor."),
    "id": ("Pemerintah kemarin mengesahkan undang-undang baru tentang kerja setelah perundingan panjang.", "Serikat pekerja mengatakan akan terus berunjuk rasa di ibu kota."),
    "fi": ("Hallitus hyväksyi eilen uuden työlain pitkien neuvottelujen jälkeen eduskunnassa.", "Ammattiliitot sanovat jatkavansa mielenosoituksia pääkaupungissa."),
    "el": ("Η κυβέρνηση ενέκρινε χθες νέο νόμο για την εργασία μετά από μακρές διαπραγματεύσεις.", "Τα συνδικάτα λένε ότι θα συνεχίσουν τις διαμαρτυρίες στην πρωτεύουσα."),
    "hi": ("सरकार ने कल लंबी बातचीत के बाद काम के बारे में एक नया कानून पारित किया है।", "संघों का कहना है कि राजधानी में विरोध जारी रहेगा।"),
    "zh": ("政府昨天经过长时间的谈判之后通过了一项关于劳动的新法律，规定了工作时间。", "工会表示将继续在首都抗议。"),
}
AROUND = "<nav><a href=/a>Home</a></nav><ul>" + "".join(f"<li><a href=/{k}>Link {k} to something else</a></li>" for k in range(6)) + "</ul>"


@pytest.mark.parametrize("lang", sorted(NEWS))
@pytest.mark.parametrize("shape", ["<article><h1>Titel</h1><p>{0}</p><p>{1}</p></article>", "<div id=content><h1>Titel</h1><p>{0}</p><p>{1}</p></div>", "<form action=/x><div><h1>Titel</h1><p>{0}</p><p>{1}</p></div></form>", "<h1>Titel</h1><table><tr><td>{0}</td></tr><tr><td>{1}</td></tr></table>", "<div><h1>Titel</h1><pre>{0}</pre><p>{1}</p></div>"])
def test_short_news_in_any_language(lang, shape):
    page = f"<html><body>{AROUND}{shape.format(*NEWS[lang])}<footer>© 2024 Company</footer></body></html>"
    assert html_text.main_text(page).split("\n\n") == ["Titel", *NEWS[lang]]


def test_what_has_nothing_against_it_stays():
    assert html_text.main_text("<p>Short.</p>") == "Short."
    for odd in ("<p>Photo © 2024 by someone who was there and took a picture of it.</p>", "<pre>x = f(y)\nreturn x</pre>", "<table><tr><td>4711</td></tr></table>", "<p>Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Omega Sigma</p>"):
        text = re.sub(r"<[^>]*>", "", odd).replace("\n", " ")
        assert html_text.main_text(page(f"<div><p>{BODY}</p>{odd}<p>{BODY}</p></div>")).split("\n\n") == [BODY, text, BODY]
    for name in ("class='market-share'", "id='related-work'", "id='ad-history'"):
        assert html_text.main_text(page(f"<article><p>{BODY}</p><section {name}><p>{BODY}</p></section></article>")) == f"{BODY}\n\n{BODY}"
    for name in ("class='share-box'", "id=comments", "class='related-posts'", "class='ad'"):
        assert html_text.main_text(page(f"<article><p>{BODY}</p><section {name}><p>{BODY}</p></section></article>")) == BODY
    assert "©" not in html_text.main_text(page(f"<div><p>{BODY}</p></div><div>© 2024 The company that made all of this</div>"))


def test_both_passes_against_brute_force():
    import random

    rng = random.Random(7)
    for _ in range(400):
        found = [html_text.Block(label=rng.choice([True, False, None, None]), boiler=rng.random() < 0.2, scope=rng.choice([0, 0, 1]), heading=rng.random() < 0.2) for _ in range(rng.randrange(1, 12))]
        for b in found:
            b.label = False if b.boiler else b.label
        want = []
        for i, b in enumerate(found):
            peers = [(abs(i - j), j > i, x.label) for j, x in enumerate(found) if x.label is not None and not x.boiler and x.scope == b.scope and j != i]
            before, after = (min((p for p in peers if p[1] is side), default=None) for side in (False, True))
            if b.label is not None:
                want.append(b.label)
            elif not any(x.label for x in found):
                want.append(True)
            elif not before or not after or before[2] == after[2]:
                want.append((before or after)[2] if before or after else b.scope > 0)
            elif b.heading:
                want.append(after[2])
            else:
                want.append(b.scope > 0 if before[0] == after[0] else min(before, after)[2])
        assert html_text._neighbours(found) == want


def test_hostile_pages_end():
    import time

    n = 1 << 20
    for page in ("<a " * 40000, "<script>" + "</script " * 40000, "<div>" * 20000 + "</p>" * 20000, "<!--" * 40000, "<div>" * (n // 15) + "</section>" * (n // 15), ("<div>" + "</section>" * 9) * (n // 100), "<form><p>x" * (n // 10), "<p class='" + "a-" * (n // 2) + "'>x"):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 6, page[:30]

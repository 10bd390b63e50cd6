"""Page bodies on pages written by hand, none of them from the test tables: ``X`` marks a line that isn't the article's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyrion.llm import body, wordings
from papyrion.llm import lines as L

PAGES = {
    "mill": """\
XSkip navigation
XBy Martha Keel
XPublished in Local History
XWe and selected partners use cookies to measure how visitors find us and to improve what we show.
XAgree
XMore options

# The mill at Upper Ashwick

The mill at Upper Ashwick was built in 1782, burnt down twice, and was rebuilt each time with money from the same family, who owned the quarry.

Its wheel, which still turns on open days, came from a foundry in the north, and was carried by barge for most of the way.

XTweet this
XPin it

X### Editor's picks
X- [Five bridges worth a walk](/walks/5-bridges)
X- [The last ferryman](/people/ferryman)

XGet our weekly digest in your inbox.

XAshwick Heritage Ltd, registered office 4 Mill Lane, company number 0012345
XSite map""",
    "recipe": """\
X[Zum Hauptinhalt](#main)
X- [Rezepte](/rezepte)
X- [Magazin](/magazin)
X- [Mein Konto](/konto)

# Rote Linsensuppe

Eine Suppe, die in einer halben Stunde fertig ist, satt macht und am nächsten Tag noch besser schmeckt.

## Zutaten

- 200 g rote Linsen
- 1 Zwiebel
- [Kreuzkümmel](https://gewuerze.test/kreuzkuemmel): frisch gemahlen

## Zubereitung

1. Die Zwiebel fein schneiden und in Öl glasig dünsten.
2. Linsen und Brühe dazugeben, zwanzig Minuten kochen lassen.

Mit Zitrone abschmecken.

XRezept drucken
XAuf die Merkliste

X## Das schmeckt auch
X[Kürbissuppe mit Ingwer](/r/18)
X[Gulasch wie bei Oma](/r/77)

X© Küchenzettel GmbH
XImpressum | Datenschutz | Kontakt""",
    "release": """\
XProducts > Server > Release notes

# Release 4.2

This release makes restarts faster, fixes three faults in the scheduler, and drops support for the old log format.

Cookie handling was rewritten: the server now signs each cookie, and rejects those it didn't sign.

| Option | Default |
| --- | --- |
| log.format | json |
| restart.wait | 10 s |

```
server --restart
```

> Read the upgrade notes first.

See [the manual](https://docs.test/manual) for the full list of options, and [the forum](https://forum.test) for help.

XEdit this page
XReport an issue
X[Previous: Release 4.1](/notes/4-1) | [Next: Release 4.3](/notes/4-3)""",
    "news": """\
XAccueil › Région › Culture

# Le théâtre rouvre ses portes

XPar Lucie Monnet

Après deux ans de travaux, le théâtre municipal rouvre vendredi, avec une pièce écrite pour l'occasion et jouée par la troupe de la ville.

La salle compte désormais 420 places, contre 510 auparavant, mais chacune voit toute la scène.

Les réservations ouvrent lundi.

XPartager
XImprimer

X**À lire aussi**
X- [Un festival sous la pluie](/culture/festival)
X- [Le musée ferme pour l'été](/culture/musee)

XInscrivez-vous à notre infolettre pour ne rien manquer.""",
    "wiki": """\
# Pump station

The pump station lifts water from the lower basin, about nine metres, into the canal.

It has three pumps, of which one runs at night, one by day, and one stands by.

## See also

- [Canal](https://encyclopedia.test/canal)
- [Lower basin](https://encyclopedia.test/basin)

Pages like this one are kept by volunteers, who meet on the first Monday of each month.""",
    "forum": """\
XForum | Regeln | Suche

# Anmeldung klappt nicht

Seit dem letzten Update kann ich mich nicht mehr anmelden, die Seite lädt nur neu, und im Protokoll steht nichts.

Hat jemand eine Idee?

> Hast du die Cookies gelöscht?

Ja, mehrmals, und auch einen anderen Browser versucht, leider ohne Erfolg.

XAntworten
XThema beobachten""",
}


def judged():
    """True, found and both of all pages' furniture lines."""
    true = found = both = 0
    for marked in PAGES.values():
        rows = marked.split("\n")
        cases = {no for no, r in enumerate(rows, 1) if r[:1] == "X"}
        got = set(body.furniture_lines("\n".join(r[1:] if r[:1] == "X" else r for r in rows), "site.test"))
        true, found, both = true + len(cases), found + len(got), both + len(got & cases)
    return true, found, both


@pytest.fixture
def no_words(monkeypatch):
    """All words of menus, buttons, sidebars, bylines and notices are forgotten."""
    for name in ("LABELS", "SIDEBAR", "BYLINES", "BUTTONS"):
        monkeypatch.setattr(L, name, frozenset())
    monkeypatch.setattr(L, "NOTICES", wordings.automaton(""))
    body._known.clear()
    yield
    body._known.clear()


def test_pages_by_hand():
    true, found, both = judged()
    assert both >= 0.95 * true and both >= 0.95 * found


def test_pages_by_hand_without_words(no_words):
    """The tree's scores alone find nearly all; what they miss are sentences that only their subject tells from the article's."""
    true, found, both = judged()
    assert both >= 0.85 * true and both >= 0.95 * found


def test_scores_decide(monkeypatch):
    """Without the scores, menus, links and stray lines would stay."""
    _, found, _ = judged()
    monkeypatch.setattr(body, "SIBLING_SHARE", -1e9)
    monkeypatch.setattr(body, "LEAST", -1e9)
    assert judged()[1] < 0.6 * found


def test_lines_of_a_site(spark, no_words):
    """Sentences that stand on many different pages of a site are the site's; copies of one page make none."""
    article = lambda k: f"# Page {k}\n\nThe subject of page {'abcdefgh'[k % 8] * (k // 8 + 1)} is told here, with commas, and at some length, as articles do."
    legal = "\n\nTexts of this house may be cited with its name, and changed by nobody else."
    data = [(k, f"https://WWW.Site.test:80/{k}", article(k) + legal) for k in range(8)]
    data += [(100 + k, "https://www.site.test/copy", article(99) + "\n\nIt has been told before, and is told again.") for k in range(8)]
    data += [(200, "https://other.test/", article(3) + legal), (201, None, article(4) + legal), data[0]]
    df = spark.createDataFrame(data, "doc long, address string, text string").withColumn("site", F.lit("clash")).withColumn("same", F.lit(0))
    got = {tuple(r) for r in body.furniture(df, "doc", "text", "address").collect()}
    assert got == {(k, 5) for k in range(8)}
    assert body.furniture(df, "doc", "text").count() == 0 == body.furniture(df.where("false"), "doc", "text", "address").count()
    bodies = {r["doc"]: r["body"] for r in body.main_bodies(df.dropDuplicates(["doc"]), "doc", "text", "address").collect()}
    assert len(bodies) == 18 and legal.strip() not in bodies[0] and legal.strip() in bodies[200] and bodies[100] == data[8][2]

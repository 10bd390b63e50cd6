"""Abusive, hateful or sexual content (problem 10).

A weighted lexicon of words and phrases in six languages is matched by an Aho-Corasick automaton over folded text: one
case, one script for look-alike letters, no accents, nothing that isn't drawn. Before that, disguised words (spelled with
digits, stars, gaps or repeated letters) are put back where they spell a word of the lexicon. Exception phrases and
contexts take weight away. A passage's score is its weight normalised by its length, a document's that of its worst
passage, so that one threat in a long text isn't lost in it; the score decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.lookalikes import _FROM, _TO, JOINED
from papyrion.session import read_table

#: Score of a passage (its weight, normalised by its length) from which its document is a case.
THRESHOLD = 2.4
#: A passage's weight is divided by one and this share of the logarithm of its length in so many characters.
LENGTH_SHARE, LENGTH_UNIT = 0.1, 150
#: What a report or rule leaves of the weight of the words that it governs.
REPORTED_SHARE = 0.25
#: Most tokens that a worker remembers; beyond that it begins anew.
REMEMBERED = 400_000

# The lexicon, kind by kind with its weight. Weight 3 makes a case by itself; smaller weights only together with others in the sentence.
LEXICON = {
    "insult": (3.0, """
idiot, idiots, moron, morons, imbecile, imbeciles, cretin, cretins, dimwit, dimwits, halfwit, numbskull, brainless, disgusting pig, filthy pig, fat pig, stupid cow,
stupid pig, dumb cow, pathetic parasite, pathetic loser, worthless piece, piece of garbage, piece of trash, piece of shit, piece of crap, piece of filth, asshole, assholes,
arsehole, dickhead, shithead, dumbass, dumbfuck, motherfucker, motherfuckers, cocksucker, son of a bitch, scumbag, scumbags, douchebag, cunt, cunts,
wanker, twat, retard, retards, retarded, whore, whores, slut, sluts, faggot, faggots, nigger, niggers, kike, spic, stupid bitch, you bitch, fucking bitch, fuck you,
fuck off, screw you, piss off, go to hell, shut up you, shut your mouth, shut the fuck up, crawl back under, fucking dumb, fucking stupid, fucking ugly, you are scum,
you are trash, you are garbage, you are vermin, you are worthless, you are disgusting, you are pathetic, you worthless, you pathetic, you disgusting, you filthy,
you stupid, you brainless, you ugly, nobody wants you, nobody likes you, nobody would miss you, no one would miss you, no one wants you, better off without you, only a loser would, only losers would, what a loser, total loser, absolute loser, bunch of losers, only a bastard would, what a bastard, bunch of bastards, hope you lose your job,
du arschloch, arschloch, arschlocher, wichser, hurensohn, fotze, schlampe, missgeburt, schwuchtel, spast, verpiss dich, halt die fresse, halt dein maul, fick dich,
leck mich am arsch, dummer idiot, stuck dreck, stuck scheisse, drecksau, dreckskerl, vollidiot, du idiot, dumme kuh, dummkopf, du hure, drecksschwein, abschaum,
ta gueule, ferme la, sale ordure, espece d'imbecile, espece de, connard, connards, connasse, salope, salaud, encule, batard, va te faire, fils de pute, pauvre con,
sale con, gros con, nique ta mere, abruti, sous merde, petasse, sale porc,
vete a la mierda, hijo de puta, hija de puta, pedazo de basura, pedazo de mierda, eres un imbecil, imbecil, gilipollas, cabron, cabrones, pendejo, pendejos, maricon, puta madre,
callate, eres un inutil, eres una basura, eres basura, que te jodan, jodete, zorra asquerosa, cerdo asqueroso, eres un idiota, eres idiota, mierdecilla, malparido,
заткнись, идиот, идиоты, идиотка, кретин, дебил, дебилы, ублюдок, ублюдки, сволочь, мразь, тварь, сука, шлюха, говнюк, мудак, мудаки, пошел на хуй, иди на хуй, пошел ты, придурок,
тупица, никому не нужен, никому не нужна, чтоб ты сдох, сдохни, пидор, пидорас, отброс общества, скотина, убейся,
馬鹿野郎, バカ野郎, ばか野郎, クソ野郎, くそ野郎, クズ野郎, このクズ, このバカ, この馬鹿, 黙れ, 死ね, 死ねよ, くたばれ, 消え失せろ, ゴミ野郎, キチガイ, きちがい, ぶっ殺, 殺すぞ, 殺してやる, クソ女, ブス野郎, 役立たずめ
"""),
    "threat": (3.0, """
kill yourself, kill your self, kys, i will kill you, i'll kill you, we will kill you, gonna kill you, i will find you, i'll find you, break your fingers, break your legs, break your neck,
break your bones, cut your throat, slit your throat, i hope you die, hope you die, hope you get cancer, you should die, you deserve to die, go die, if you died, you were dead, you will regret being born, you deserve to suffer,
i know where you live, beat you up, beat you to death, rape you, shoot you in the, burn your house,
ich bringe dich um, ich finde dich, bring dich um, ich mach dich kalt, stirb endlich, hang dich auf, geh sterben,
je vais te tuer, je vais te retrouver, creve, va mourir, va crever, suicide toi, te casser la gueule,
te voy a matar, voy a matarte, muerete, ojala te mueras, te voy a encontrar, te voy a romper,
я тебя убью, убью тебя, я тебя найду, убей себя, сдохни уже, повесься
"""),
    "hatred": (3.0, """
are vermin, are a disease, are subhuman, are cockroaches, are a plague, are scum, are filth, are born thieves, are born criminals, are thieves and liars,
subhuman, subhumans, untermensch, be driven out of the country, driven out of our country, wiped out, be exterminated, should be gassed, breed like rats, breed like roaches, breed like vermin, breed like cockroaches, send them all back, hang every one of, hang them all, kill them all, shoot them all,
burn the houses of, burn them all, burn down their houses, keep the filthy, the filthy, away from our schools, don't deserve any rights, do not deserve any rights, or any rights, have ruined this town, ruined this country,
go back to your country, never trust a, white power, heil hitler, gas the, death to all,
sind ungeziefer, sind abschaum, sind parasiten, sind tiere, gehoren vertrieben, gehoren vergast, gehoren ausgerottet, gehoren erschossen, auslander raus, sind eine plage, sind untermenschen,
sont des parasites, sont des animaux, sont de la vermine, sont une plague, sont des rats, il faut les chasser, il faut les exterminer, il faut les tuer, sont des sous hommes,
son una plaga, son parasitos, son animales, son escoria, son alimanas, hay que echarlos, hay que exterminarlos, hay que matarlos, son ratas,
паразиты, гоните их, выродки, недочеловеки, нелюди, вон из нашей страны, надо уничтожить, надо истребить, перестрелять, их всех убить,
は害虫, 害虫だ, 追い出せ, ゴキブリ民族, 皆殺し, 根絶やしに, 国へ帰れ, 寄生虫だ, 人間じゃない
"""),
    "sexual": (3.0, """
porn, porno, pornos, pornography videos, free porn, xxx videos, xxx video, hardcore xxx, milf, milfs, gangbang, blowjob, handjob, cumshot, creampie, deepthroat, bukkake, hentai, camgirl, camgirls,
naked girls, nude girls, naked women, hot girls on cam, girls on cam, naked body, naked bodies, licking your, suck my, sucking his, stroked his, hard cock, his cock, her pussy, wet pussy, pussy, big tits, huge tits, tits, titties, boobs,
took off her panties, her panties, begged him to fuck, fuck her, fuck me, fucked her, fucking her, naked and moaning, send nudes, send me nudes, nudes, so horny, horny, adult escorts, escorts full service, full service escorts, escort service, sex chat,
sex cam, sexcam, live sex, anal sex, dildo, cum on, jerk off, jerking off, masturbate, uncensored orgy, hot milf, cock hard, dick pic, dick pics, suck his, ride his, spread her legs, squirting, threesome,
gratis pornos, geile nackte, nackte weiber, nackte madchen, nackte frauen, geile weiber, geile frauen, sexvideos, ficken, gefickt, muschi, titten, sexkontakte, schwanz lutschen,
videos porno, video porno, filles nues, femmes nues, nues et chaudes, baise moi, baiser avec, sucer sa, grosse bite, gros seins, chaudasse, plan cul, sexe gratuit,
porno gratis, chicas desnudas, mujeres desnudas, desnudas muy calientes, follame, follar, chupame, tetas grandes, putas calientes, sexo gratis, coño mojado,
порно, голые девушки, голые бабы, голые девки, трах, трахни меня, секс видео, минет, шлюхи, проститутки, интим услуги, сиськи,
エロ動画, エロい, 裸の女, 無料エロ, アダルト動画, おっぱい丸出し, 無修正, 巨乳, 素人ハメ撮り, 中出し, 風俗嬢
"""),
    "rude": (1.5, """
fuck, fucking, fucked, bullshit, bitch, dumb, stupid, ugly, filthy, disgusting, pathetic, worthless, garbage, vermin, parasite, parasites, parasiten, pig, scum, trash, worm, loser, losers, bastard, bastards, orgy, orgies, shut up, naked, nude, uncensored, hardcore, xxx, sexy, erotic,
cock, dick, escorts, hot girls, moaning, moaned, inside her, bare breasts, between her thighs, ought to be put down, should be put down, should be deported, you people, illegals, scheisse, mierda, merde, basura, ordure, parasites, plaga, ungeziefer, nackte, desnudas, nues, geile, дерьмо, говно, хуй, тупой, hate you, hate them
"""),
    "addressed": (1.5, """
you are a, you're a, you are an, you're an, you are such, you're such, you are nothing but, you utter, you absolute, you total, you complete, you miserable, you little, you piece of, you bunch of, all of you are,
du bist ein, du bist eine, du elender, du elende, ihr seid, tu es un, tu es une, vous etes des, espece de, eres un, eres una, sois unos, pedazo de, ты просто, ты настоящий, вы все, お前は, お前ら, てめえ,
they are all, they are nothing but, all of them are, these people are, those people are, are animals, are parasites, are rats, sie sind alle, ils sont tous, son todos, они все
"""),
    "mild": (0.5, "damn, damned, hell, crap, shit, sex, sexual, verdammt, putain, joder, блин, черт"),
}

# Wordings in which an entry is no abuse; an entry inside one of them doesn't count.
EXCEPTIONS = """
calling someone an idiot, call someone an idiot, called an idiot, i am an idiot, i'm an idiot, i was an idiot, i felt like an idiot, my idiot mistake, idiot proof, idiot's guide, i'm such an idiot, i am a moron,
i'm a loser, i am a loser, sore loser board, winners and losers, losers of the match, winner and loser, the filthy rich, filthy water, filthy lucre, naked domain, naked eye, naked mole rat, naked singularity, naked option, nude in oil, nude painting, nude portrait,
nude mice, nude color, bitch nursed, the bitch and her puppies, breeding bitch, bitch gave birth, cock crowed, cock crows, cocktail, peacock, shuttlecock, hot sauce, adult education, penetration test, penetration tests, breast exams, breast cancer, safe sex, sexual health,
sex education, kill the process, kill the parent process, kill the task, dummy variable, damn printer, stupid mistake of mine, my stupid mistake, hit harder, strip the binary, execute the child, wiped out the file, wiped out by the update, was wiped out by, disk is wiped out,
war on drugs are a disease, diseases are a disease, rats are vermin,
bastard sword, bastard title, bastard file, the great tit, great tits, blue tits, coal tits, tits and, pussy willow, pussycat, pussy cat, pussy riot, dick van dyke, moby dick, philip k. dick, cum laude, never trust a file, never trust a user, never trust a client, never trust a single, never trust a default,
gas the engine, anti-porn, porn filter, porn blocker, porn addiction, revenge porn law, food porn, no porn, block porn, against porn, milf filter, orgy of colours, orgy of colors, orgy of violence, retarded growth, fire retarded, flame retarded
"""

# Words of reports, rules, medicine, zoology, art and technology; the weight of what stands in a sentence with two of them, or one of the first kind, is cut.
REPORTING = """
code of conduct, forbids insults, forbid insults, leads to a warning, moderators removed, moderator removed, hate speech, was studied, were studied, countered, report describes, reports describe, researchers, study of, studies of, survey of abuse, abusive comments, the word, the term, the slur, slurs, is considered offensive,
are prohibited, is prohibited, not allowed, will be banned, was convicted, was arrested, police said, the court, according to police, the novel, novel's, villain, the exhibition, breeder, puppies, the clinic, veterinar, zoolog, biolog, gynaecolog, gynecolog, medical, anatomy, portraits, painting, sculpture, museum of art,
hassrede, hausordnung verbietet, beleidigungen sind verboten, discours de haine, insultes sont interdites, discurso de odio, los insultos estan prohibidos, язык вражды, оскорбления запрещены, ヘイトスピーチ, 誹謗中傷, 禁止されています
"""

# A threat names a deed and a part of the body that is yours.
DEEDS = "break, smash, crush, snap, cut, slit, bash, kick, punch, rip, stab, carve"
BODY = "fingers, legs, neck, bones, teeth, skull, face, throat, jaw, head, eyes, heart, ribs"

_INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]))


def _fold_table() -> dict[int, str | None]:
    """One case, one script for letters drawn alike, no accents, nothing that isn't drawn."""
    table: dict[int, str | None] = {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in base if not unicodedata.combining(c)).lower()
        if base and base != chr(code) and base.isalnum():
            table[code] = base
    table |= {ord("ß"): "ss", ord("ẞ"): "ss", ord("ø"): "o", ord("’"): "'", ord("‘"): "'"}
    table |= {c: None for c in range(0x300, 0x370)}
    for other, base in zip(_FROM, _TO, strict=True):
        base = unicodedata.normalize("NFD", base).lower()[0] if base not in "ヘベペ" else base
        table[ord(other)] = base
        if other.lower() != other and len(other.lower()) == 1:
            table.setdefault(ord(other.lower()), base)
    table |= {ord(k): v.lower() for k, v in JOINED.items()}
    table |= {ord(c): None for c in _INVISIBLE}
    table[ord("ё")] = table.get(ord("е"), "е")
    return table


_FOLD = _fold_table()
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_LETTER = r"[^\W\d_]"
_SPELLED = re.compile(rf"(?<![\w*])\w(?:[ .\-_·*]\w){{2,}}(?![\w*])")
_GAPS = re.compile(r"[ .\-_·*]\w[ .\-_·*]\w[ .\-_·*]?|^\w[ .\-_·*]\w[ .\-_·*]")
_STARRED = re.compile(rf"(?<![*\w]){_LETTER}+\*+[\w*]*")
_LEETED = re.compile(rf"(?<![\w@$-])(?=[a-z@$!0-9]*[a-z])[a-z]*[0-9@$!][a-z0-9@$!]*(?![\w@$])")
_LONG = re.compile(rf"\w*({_LETTER})\1\1\w*")
_SENTENCE = re.compile(r"[.!?。！？\n]+(?=\s|$)|[。！？\n]+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_CLAUSE = re.compile(r"[;()—]|\s–\s")
_DIRECT = re.compile(r"\b(?:you|your|yourself|you're|du|dich|dein|deine|tu|toi|ta|ton|te|eres|ты|тебя|твой|твоя)\b")
_QUOTES = re.compile(r"[\"“”„«»「」]|(?<!\w)'|'(?!\w)")

_SPACE = re.compile(r"[^\S ]\s*| \s+")
_PARAGRAPH = "\u2029"


def _one_space(m: re.Match) -> str:
    """White space as one sign: a blank, a line's end or a paragraph's end."""
    ends = m[0].replace("\r\n", "\n").replace("\r", "\n")
    return " " if "\n" not in ends and _PARAGRAPH not in ends else "\n" if ends.count("\n") == 1 and _PARAGRAPH not in ends else _PARAGRAPH


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def _entries(text: str) -> list[str]:
    return [e for e in (fold(x.strip()) for x in text.replace("\n", " ").split(",")) if e]


class Lexicon(dict):
    """The automaton, and the lexicon's words for putting disguised ones back; as a mapping, the plain forms of tokens."""

    def __init__(self) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[str, float]] = {}
        for weight, text in LEXICON.values():
            for e in _entries(text):
                entries.setdefault(e, ("hit", weight))
        for deed in _entries(DEEDS):
            for part in _entries(BODY):
                entries.setdefault(f"{deed} your {part}", ("hit", LEXICON["threat"][0]))
        for e in _entries(EXCEPTIONS):
            entries[e] = ("except", 0.0)
        for e in _entries(REPORTING):
            entries[e] = ("report", 0.0)
        for e, (kind, weight) in entries.items():
            self.automaton.add_word(e, (e, kind, weight, bool(_CJK.search(e))))
        self.automaton.make_automaton()
        self.words = {w for e, (kind, weight) in entries.items() if kind == "hit" and weight >= 1 for w in re.findall(r"\w+", e) if len(w) > 2}
        # Entries without their spaces and their words, for letters with gaps between them; exceptions stand for themselves there too.
        self.joined = ahocorasick.Automaton()
        for w in self.words:
            self.joined.add_word(w, (len(w), w))
        for e, (kind, _) in entries.items():
            if kind != "report" and len(bare := e.replace(" ", "")) > 2 and bare.isalnum():
                self.joined.add_word(bare, (len(bare), e))
        self.joined.make_automaton()
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.words):
            self.by_length.setdefault(len(w), []).append(w)

    def spelled(self, m: re.Match) -> str:
        """Letters with gaps between them: every entry in them is put back, of overlapping ones the longest."""
        word = re.sub(r"[ .\-_·*]", "", m[0])
        found = sorted(((-n, end - n + 1, e) for end, (n, e) in self.joined.iter(word)))
        kept: dict[int, tuple[int, str]] = {}
        for n, start, e in found:
            if all(start - n <= a or b <= start for a, (b, _) in kept.items()):
                kept[start] = (start - n, e)
        if not kept:
            return m[0]
        parts, at = [], 0
        for start, (end, e) in sorted(kept.items()):
            parts += [*word[at:start], e]
            at = end
        return " ".join([*parts, *word[at:]])

    def starred(self, m: re.Match) -> str:
        token = m[0]
        pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in token))
        found = [w for w in self.by_length.get(len(token), ()) if pattern.fullmatch(w)]
        # Of words of one weight any will do; the others may be part of a phrase, so all are given to the automaton.
        return " ".join(found) if found else token

    def leeted(self, m: re.Match) -> str:
        token = m[0].rstrip("!")
        for c in (token.translate(_LEET), token.replace("1", "l").translate(_LEET)):
            if c in self.words or (c.endswith("s") and c[:-1] in self.words):
                return c
        return m[0]

    def long(self, m: re.Match) -> str:
        for keep in (r"\1", r"\1\1"):
            c = re.sub(r"(.)\1{2,}", keep, m[0])
            if c in self.words or (c.endswith("s") and c[:-1] in self.words):
                return c
        return m[0]

    def __missing__(self, token: str) -> str:
        """A token, folded and with a disguised word put back; tokens repeat, so they are remembered."""
        if len(self) >= REMEMBERED:
            self.clear()
        t = fold(token)
        if "*" in t:
            t = _STARRED.sub(self.starred, t)
        t = _LONG.sub(self.long, _LEETED.sub(self.leeted, t))
        if len(token) <= 200:
            self[token] = t
        return t

    def plain(self, text: str) -> str:
        """Folded text with disguised words of the lexicon put back."""
        t = " ".join(map(self.__getitem__, _SPACE.sub(_one_space, text).split(" ")))
        return _SPELLED.sub(self.spelled, t) if _GAPS.search(t) else t

    def rate(self, text: str) -> tuple[float, float]:
        """Total weight, and the score of the worst passage."""
        t = self.plain(text)
        # Entries may stand across a line's end, but not across a paragraph's; both end a sentence.
        running, t = t.replace("\n", " "), t.replace(_PARAGRAPH, "\n")
        hits, exceptions, reports = [], [], []
        for end, (e, kind, weight, cjk) in self.automaton.iter(running):
            start = end - len(e) + 1
            if not cjk and ((start and (t[start - 1].isalnum())) or (end + 1 < len(t) and t[end + 1].isalnum())) and not (kind == "report" and not (start and t[start - 1].isalnum())):
                continue
            (hits if kind == "hit" else exceptions if kind == "except" else reports).append((start, end, weight))
        if not hits:
            return 0.0, 0.0
        ends = [m.end() for m in _SENTENCE.finditer(t)]
        sentences: dict[int, list[tuple[int, int, float]]] = {}
        for start, end, weight in hits:
            if any(a <= start and end <= b for a, b, _ in exceptions):
                continue
            sentences.setdefault(bisect_right(ends, start), []).append((start, end, weight))
        parts = sorted({*ends, *(m.end() for m in _CLAUSE.finditer(t))}) if reports else ends
        reported = {bisect_right(parts, a) for a, _, _ in reports}
        total = worst = 0.0
        for k, found in sentences.items():
            begin, end = ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(t)
            # Of entries that overlap the heavier counts.
            found.sort(key=lambda x: (-x[2], x[0] - x[1]))
            used, weight, told = [], 0.0, 0.0
            for start, stop, w in found:
                if not any(start <= b and a <= stop for a, b in used):
                    used.append((start, stop))
                    if bisect_right(parts, start) in reported and self.governed(t, begin, start, stop):
                        told += w
                    else:
                        weight += w
            weight += min(told * REPORTED_SHARE, THRESHOLD / 2)
            total += weight
            worst = max(worst, weight / (1 + LENGTH_SHARE * math.log1p((end - begin) / LENGTH_UNIT)))
        return total, worst

    def governed(self, t: str, begin: int, start: int, stop: int) -> bool:
        """Whether a report in its clause is about an entry: it is quoted, or isn't said to someone."""
        if len(_QUOTES.findall(t, begin, start)) % 2:
            return True
        return not _DIRECT.search(t, max(begin, start - 12), stop + 1)


_lexicon: list[Lexicon] = []


def _rate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _lexicon:
        _lexicon.append(Lexicon())
    lexicon = _lexicon[0]
    for b in batches:
        rated = [lexicon.rate(t) if t else (0.0, 0.0) for t in b.column(2).to_pylist()]
        totals, scores = (pa.array([x[k] for x in rated], pa.float64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), scores, totals, pa.array([w >= THRESHOLD for _, w in rated], pa.bool_())], names=["doc_id", "source", "score", "total", "abusive"])


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, score (of the worst passage), total (the weight of all) and abusive, one row for each row.

    Defined cases: null and empty texts score 0; a null id or source and repeated rows stay as they are; texts are read
    whole at any length; other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select("doc_id", "source", "text")
    return rows.mapInArrow(_rate_batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, score double, total double, abusive boolean")


def p10_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("abusive").select("doc_id").distinct()


def p10_rates(spark, sf_dir: str) -> DataFrame:
    """Number of documents, of abusive ones, and their share for every source."""
    scores = p10_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"))
    return scores.withColumn("rate", F.col("n_abusive") / F.col("n_documents"))

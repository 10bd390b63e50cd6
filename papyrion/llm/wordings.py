"""Fixed wordings of page furniture and of residue in six languages, for problems 3 and 6.

``X`` in a wording stands for a name (of a site or person), ``#`` for a number, ``…`` for any words.
"""

from __future__ import annotations

import re

# The words of site menus.
MENU = """
home, about us, about, contact, contact us, products, pricing, prices, support, documentation, docs, guides, blog, search, sign in, log in, login, sign up, careers, jobs, status, community, downloads, download, news, help, faq, shop, services, features, account, menu,
start, startseite, über uns, kontakt, produkte, preise, hilfe, anleitungen, aktuelles, suche, anmelden, abmelden, impressum, datenschutz, karriere, leistungen, gemeinschaft, dokumentation,
accueil, à propos, contacts, produits, tarifs, assistance, actualités, recherche, connexion, aide, téléchargements, communauté, carrières, mentions légales, boutique,
inicio, quiénes somos, contacto, productos, precios, ayuda, guías, noticias, buscar, acceder, descargas, comunidad, empleo, tienda, servicios,
главная, о нас, контакты, продукты, цены, поддержка, справка, новости, поиск, войти, загрузки, блог, вакансии, документация, услуги,
ホーム, 会社概要, お問い合わせ, 製品, 料金, サポート, ガイド, ニュース, 検索, ログイン, ブログ, 採用情報, ダウンロード, ヘルプ
"""

# Headings of sidebars.
SIDEBAR = """
related articles, related posts, related, you may also like, trending now, trending, popular this week, most popular, most read, recently viewed, more from this section, more stories, recommended for you, read next, see also on this site,
ähnliche beiträge, das könnte sie auch interessieren, meistgelesen, beliebte beiträge, mehr zum thema, zuletzt angesehen, weitere artikel,
les plus lus, à lire aussi, articles similaires, vous aimerez aussi, populaires cette semaine,
lo más leído, también te puede interesar, artículos relacionados, más leídos, más noticias,
популярное, читайте также, похожие статьи, самое читаемое, вам может понравиться, недавно просмотренные,
人気の記事, 関連記事, おすすめ記事, 最近見たページ, こちらもおすすめ, よく読まれている記事
"""

# Buttons of cookie notices and the like.
BUTTONS = """
accept all, accept, accept cookies, reject all, reject, only necessary, necessary only, manage choices, manage preferences, ok, got it, ok, got it., i agree, allow all, decline, settings, customize,
alle akzeptieren, akzeptieren, ablehnen, alle ablehnen, einstellungen, nur notwendige, zustimmen,
tout accepter, accepter, tout refuser, refuser, paramétrer, continuer sans accepter,
aceptar todo, aceptar, rechazar, rechazar todo, configurar, принять, принять все, отклонить, настроить, 同意する, 拒否する, 設定, すべて許可
"""

# Labels of page tools: skip links, sharing, feedback, languages.
TOOLS = """
skip to content, skip to main content, skip navigation, zum inhalt springen, aller au contenu, saltar al contenido, ir al contenido, перейти к содержанию, перейти к содержимому, 本文へスキップ, 本文へ移動,
back to top, nach oben, haut de page, retour en haut, volver arriba, наверх, ページの先頭へ, site map, sitemap, print, print this page, share, tweet this, pin it, copy link, email this, drucken, teilen, imprimer, partager, imprimir, compartir, печать, поделиться, 印刷, 共有,
accessibility statement, terms of use, terms of service, privacy policy, impressum, datenschutz, agb, mentions légales, aviso legal, privacidad, условия, конфиденциальность, 利用規約, プライバシーポリシー
"""

# Beginnings of bylines.
BYLINES = """
by, written by, posted by, published by, published in, photo, photos, text, words, last updated, von, text von, autor, autorin, veröffentlicht am, par, écrit par, publié le, por, escrito por, publicado, автор, текст, опубликовано, 文, 著者, 執筆, 投稿
"""

# Terms of notices on cookies, rights, liability, subscriptions and the like.
NOTICES = """
cookie, your consent, your privacy, tracking technologies, on your device, all rights reserved, copyright, ©, without warranty, no warranty, written consent, written permission, terms of use, terms of service, privacy policy, registered office, registered in, company number, trade name, trademark,
newsletter, subscribe, unsubscribe, email address, e-mail address, your inbox, was this page helpful, was this article helpful, follow us, powered by,
rundbrief, e-mail-adresse, rechte vorbehalten, ohne gewähr, haftet nicht, keine haftung, nutzungsbedingungen, datenschutzerklärung, handelsregister, abonnieren, war diese seite hilfreich, auf ihrem gerät,
droits réservés, traceurs, sans garantie, infolettre, lettre d'information, inscrivez-vous, abonnez-vous, adresse e-mail, mentions légales, politique de confidentialité, reproduction interdite, sur votre appareil, cette page vous a-t-elle été utile,
derechos reservados, sin garantía, boletín, suscríbete, correo electrónico, aviso legal, política de privacidad, prohibida la reproducción, en su dispositivo, te ha sido útil esta página,
права защищены, без гарантий, рассылк, подпишитесь, политика конфиденциальности, перепечатка, на вашем устройстве, была ли эта страница полезна,
クッキー, メールマガジン, 無断転載, 著作権, 利用規約, プライバシー, 予告なく変更, 端末に情報を保存, このページは役に立ちましたか
"""

# Parts of error messages and of notices that scripts are needed, a language a line. What is missing, and how it fails; together in a short sentence they make a message.
MISSING = """
page, url, address, site, website, content, document, file, resource, server, service, link, domain, request, connection, session, database, access, what you were looking for, what you are looking for,
seite, adresse, inhalt, server, zugriff, dienst, datei, ressource, verbindung, sitzung,
page, adresse, contenu, serveur, accès, service, fichier, connexion, session,
página, dirección, contenido, servidor, acceso, servicio, archivo, conexión, sesión, sitio,
страниц, адрес, сервер, доступ, сайт, содержимо, соединени, сесси,
ページ, サイト, サーバ, アクセス, コンテンツ, お探し
"""
FAILS = """
not found, doesn't exist, does not exist, never existed, couldn't find, could not find, can't find, cannot find, could not be found, couldn't be found, can't be found, cannot be found, no longer available, not available, unavailable, can't be reached, cannot be reached, can't be displayed, isn't working, is not working,
denied, forbidden, went wrong, expired, failed, did not answer, timed out, bad gateway, internal server error, has moved, was removed, has been removed, don't have permission, do not have permission, not authorized, not allowed to, for sale,
nicht gefunden, kein inhalt gefunden, nicht verfügbar, verweigert, existiert nicht, nicht erreichbar, abgelaufen, keine berechtigung, interner serverfehler, fehlgeschlagen,
introuvable, n'existe, refusé, indisponible, n'est plus disponible, expirée, erreur interne,
no encontrad, no existe, denegado, no disponible, no se ha encontrado, no se encuentra, error interno, expirado,
не найден, не существует, запрещ, недоступ, внутренняя ошибка, истек,
見つかりません, 存在しません, 拒否され, 権限がありません, 権がありません, 利用できません, 表示できません
"""
# Messages by themselves.
MESSAGES = """
something went wrong, an error occurred, an unexpected error, fatal error, access denied, permission denied, bad gateway, gateway timeout, internal server error, service unavailable, too many requests, session expired, checking your browser, verifying you are human, verify you are human, just a moment, one moment please,
no such page, loading..., loading…, try again later, try the search, request id, ray id, incident id, error code, error id, page not found, file not found, nothing was found, no content found, return to the home page, go back to the home page,
fehler aufgetreten, fehlercode, versuchen sie es später, serverfehler, kein inhalt gefunden, einen moment bitte, erreur est survenue, code d'erreur, réessayez plus tard, ha ocurrido un error, código de error, inténtelo más tarde, inténtalo más tarde, произошла ошибка, код ошибки, повторите попытку позже, エラーが発生, サーバーエラー, しばらくしてから
"""
SCRIPTS = """
javascript, java script, scripts, скрипт, スクリプト
"""
SWITCHED = """
enable, turn on, turned on, turn it on, switch on, switched on, switched off, turned off, activate, disabled, needs, need to, requires, required, must be, does not support, doesn't support, works best, blocks, blocked, without,
aktivieren, aktiviert, einschalten, deaktiviert, ausgeschaltet, benötigt, erforderlich, activer, activez, désactivé, nécessite, requis, activa, active, activar, habilita, desactivado, necesita, requiere, включ, отключ, требу, необходим, 有効, 無効, 必要, オン
"""
ERROR = """
error, fehler, erreur, ошибка, エラー
"""
LOADING = """
loading, loading..., loading…, please wait, wird geladen, chargement, chargement en cours, cargando, загрузка, 読み込み中
"""

# Filler text.
FILLER = r"""
lorem ipsum…
sample text…
sample text goes here…
dummy text…
dummy paragraph number #.
this is placeholder copy…
this is placeholder text…
placeholder text…
your headline here
your text here
your title here
insert text here…
enter your text…
write something about … here.
write something here…
add content here…
todo: …
todo
tbd
tba
coming soon
test test…
asdf…
xxx xxx…
foo bar baz…
text text text…
hello world!
hello world
blindtext…
beispieltext…
hier steht ein text…
mustertext…
texte d'exemple…
texte factice…
faux texte…
texto de ejemplo…
texto de prueba…
текст-заполнитель…
пример текста…
рыба-текст…
здесь будет текст…
ダミーテキスト…
サンプルテキスト…
ここにテキスト…
ここに本文…
これはダミー…
これはサンプル…
テストテスト…
"""

# Words of filler that imitates Latin.
LATIN = frozenset("""
lorem ipsum dolor sit amet consectetur consec adipiscing elit elitur sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure
reprehenderit voluptate velit esse cillum fugiat fugat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum nonumy nonumet eirmod invidunt aliquyam erat voluptua accusam justo duo dolores rebum stet clita kasd gubergren
sanctus takimata vestra velam quorent milarem axime porrum osperit dignum candum sedula tunc pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas vestibulum
""".split())


def words(text: str) -> frozenset[str]:
    return frozenset(w.strip() for w in text.replace("\n", " ").replace("ok, got it", "ok\x00 got it").split(",") if w.strip()) | ({"ok, got it"} if "ok, got it" in text else frozenset())


def automaton(terms: str | dict[str, str]):  # noqa: ANN201 - of an optional library
    """An automaton over terms; what it finds is the term, or its role where terms are given by roles. A term of two roles counts for the first."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for role, text in (terms if isinstance(terms, dict) else {"": terms}).items():
        for w in words(text):
            if w not in out:
                out.add_word(w, role or w)
    if len(out):
        out.make_automaton()
    return out


_NAME = r"[^\n.!?。]{1,60}?"
_PERSON = r"[^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){1,3}"


class Wordings:
    """Wordings that whole lines are held against. An automaton over each wording's longest fixed part picks the few expressions to try."""

    def __init__(self, text: str) -> None:
        import ahocorasick

        by_part: dict[str, list[str]] = {}
        for line in text.strip().split("\n"):
            p = re.escape(line).replace(r"\ ", " ").replace(r"X\?", f"(?:{_NAME})?").replace("X", _NAME).replace("P", _PERSON).replace(r"\#", r"\d+").replace("#", r"\d+").replace("…", r".*")
            part = max(re.split(r"X\?|[XP#…]", line), key=len)
            by_part.setdefault(part if part.strip() else line[:1], []).append(p)
        self.automaton = ahocorasick.Automaton()
        for part, ps in by_part.items():
            self.automaton.add_word(part, [re.compile(p, re.DOTALL) for p in ps])
        self.automaton.make_automaton()

    def fullmatch(self, text: str) -> bool:
        tried: set[int] = set()
        for _, ps in self.automaton.iter(text):
            if id(ps) not in tried:
                tried.add(id(ps))
                if any(p.fullmatch(text) for p in ps):
                    return True
        return False

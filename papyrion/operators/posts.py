"""Posts of a short-message site: addresses, normal form of the syndication payload, threads and Markdown."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOSTS = r"(?:www\.|mobile\.)?(?:x\.com|twitter\.com)"
_POST = rf"(?i)^https?://{_HOSTS}/([A-Za-z0-9_]{{1,15}})/status(?:es)?/(\d+)"
_S = T.StringType()
_MEDIA = T.ArrayType(T.StructType([T.StructField("type", _S), T.StructField("url", _S)]))
_FLAT = [T.StructField(n, _S) for n in ("author", "handle", "created_at", "text", "permalink")] + [T.StructField("links", T.ArrayType(_S)), T.StructField("media", _MEDIA), T.StructField("article", T.StructType([T.StructField(n, _S) for n in ("title", "preview", "url")]))]
#: A post; a quoted post is one level deep, as it is shown.
POST = T.StructType([*_FLAT, T.StructField("reposted_by", _S), T.StructField("quoted", T.StructType(_FLAT))])


def post_parts(url: Column) -> Column:
    """handle and id of a post's address, null for others."""
    return F.when(url.rlike(_POST), F.struct(F.regexp_extract(url, _POST, 1).alias("handle"), F.regexp_extract(url, _POST, 2).alias("id")))


def syndication_token(post_id: str) -> str:
    """The token that the syndication address wants: id / 1e15 x pi in base 36, without zeros and the point."""
    value = int(post_id) / 1e15 * math.pi
    whole, digits, out = int(value), "0123456789abcdefghijklmnopqrstuvwxyz", ""
    fraction = value - whole
    while whole:
        whole, r = divmod(whole, 36)
        out = digits[r] + out
    for _ in range(12):
        fraction *= 36
        out += digits[int(fraction)]
        fraction -= int(fraction)
    return out.replace("0", "")


def normalize(raw: dict) -> dict:
    """The normal form of one payload; a repost is its original, with who reposted it."""
    if raw.get("retweeted_status"):
        return normalize(raw["retweeted_status"]) | {"reposted_by": (raw.get("user") or {}).get("screen_name")}
    user, entities = raw.get("user") or {}, (raw.get("entities") or {}).get("urls") or []
    # The display range counts UTF-16 units.
    units = str(raw.get("text") or "").encode("utf-16-le", "surrogatepass")
    start, end = (raw.get("display_text_range") or [0, len(units) // 2])[:2]
    text = units[2 * start : 2 * end].decode("utf-16-le", "replace")
    for e in entities:
        if e.get("url") and e.get("expanded_url"):
            text = text.replace(e["url"], e["expanded_url"])
    text = html.unescape("\n".join(line.rstrip() for line in text.strip().split("\n")))
    media = [{"type": m.get("type"), "url": m.get("media_url_https") if m.get("type") == "photo" else m.get("expanded_url") or m.get("media_url_https")} for m in raw.get("mediaDetails") or []]
    out = {"author": user.get("name"), "handle": user.get("screen_name"), "created_at": raw.get("created_at"), "text": text, "permalink": f"https://x.com/{user.get('screen_name')}/status/{raw.get('id_str')}", "links": [e["expanded_url"] for e in entities if e.get("expanded_url")], "media": media, "article": None, "reposted_by": None, "quoted": None}
    if raw.get("article"):
        plain = lambda k: html.unescape(str(raw["article"].get(k) or ""))
        out["article"] = {"title": plain("title").strip(), "preview": re.sub(r"\s*\n+\s*", " ", plain("preview_text")).strip(), "url": out["links"][0] if out["links"] else None}
    if raw.get("quoted_tweet"):
        quoted = normalize(raw["quoted_tweet"])
        out["quoted"] = {f.name: quoted.get(f.name) for f in _FLAT}
    return out


def _body(post: dict, marks: str, header: bool) -> list[str]:
    lines = [f"{marks} **{post['author']}** (@{post['handle']}) · {str(post['created_at'] or '')[:10]}", marks] if header else []
    if post.get("article"):
        a = post["article"]
        lines += [f"{marks} **{a['title']}**", marks, f"{marks} {a['preview']}", marks, f"{marks} [Read the full article on X]({a['url']})"]
    else:
        lines += [f"{marks} {line}" if line else marks for line in str(post.get("text") or "").split("\n")]
    if post.get("media"):
        lines.append(marks)
        lines += [f"{marks} ![tweet image]({m['url']})" if m["type"] == "photo" else f"{marks} [Video]({m['url']})" for m in post["media"]]
    return lines


def to_markdown(post: dict, thread: list[dict] | None = None) -> str:
    """A post as quoted Markdown: body, quoted post one level deeper, the author's follow-ups, and the address."""
    lines = [f"> Reposted by **@{post['reposted_by']}**", ">"] if post.get("reposted_by") else []
    lines += _body(post, ">", True)
    if quoted := post.get("quoted"):
        lines += [">", f"> Quoting **{quoted['author']}** (@{quoted['handle']}) · {str(quoted['created_at'] or '')[:10]}:", *_body(quoted, ">>", False), ">>", f">> [View quoted tweet on X]({quoted['permalink']})"]
    for follow in thread or []:
        lines += [">", "> --- Author's follow-up ---", ">", *_body(follow, ">", True)]
    return "\n".join([*lines, ">", f"> [View on X]({post['permalink']})"])


@F.pandas_udf(POST)
def parse_post(payloads: pd.Series) -> pd.DataFrame:
    """Payloads (JSON text) in normal form; what can't be read is null in every field."""
    import json

    rows = []
    for text in payloads:
        try:
            raw = json.loads(text)
            rows.append(normalize(raw) if isinstance(raw, dict) and raw.get("id_str") else dict.fromkeys(POST.names))
        except (TypeError, ValueError):
            rows.append(dict.fromkeys(POST.names))
    return pd.DataFrame(rows, columns=POST.names)


def threads(focal: DataFrame, replies: DataFrame) -> DataFrame:
    """Focal posts (post_id, payload, reply_ids) with ``markdown``: the post and those replies (post_id, payload) that could be read, in the order of reply_ids."""
    wanted = focal.select("post_id", F.posexplode_outer("reply_ids").alias("at", "reply_id"))
    found = wanted.join(replies.select(F.col("post_id").alias("reply_id"), F.col("payload").alias("reply")), "reply_id").groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reply"))), lambda r: r["reply"]).alias("replies"))

    def render(batches):  # noqa: ANN001, ANN202
        import json

        def read(text: str | None) -> dict | None:
            try:
                raw = json.loads(text or "")
                return normalize(raw) if raw.get("id_str") else None
            except (ValueError, AttributeError):
                return None

        for b in batches:
            out = []
            for payload, follow in zip(b["payload"], b["replies"], strict=True):
                post = read(payload)
                out.append(to_markdown(post, [p for r in (follow if follow is not None else []) if (p := read(r))]) if post else None)
            yield pd.DataFrame({"post_id": b["post_id"], "markdown": out})

    return focal.join(found, "post_id", "left").select("post_id", "payload", "replies").mapInPandas(render, T.StructType([focal.schema["post_id"], T.StructField("markdown", _S)]))


def post_capture(post: Column, markdown: Column) -> Column:
    """The capture result of a post: title ``author on X``, its first line as description."""
    first = F.regexp_extract(post["text"], r"^([^\n]*)", 1)
    return F.struct(F.concat(post["author"], F.lit(" on X")).alias("title"), post["permalink"].alias("url"), F.lit("tweet").alias("mode"), markdown.alias("markdown"), first.alias("description"))

"""Column expressions on addresses, failures and stream descriptions; the network is never touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of each platform, those that often need a sign-in, and endings of media files.
PLATFORMS = {
    "facebook": ("facebook.com", "fb.watch", "fb.me"),
    "x": ("twitter.com", "x.com", "t.co"),
    "tiktok": ("tiktok.com",),
    "youtube": ("youtube.com", "youtu.be"),
    "instagram": ("instagram.com",),
}
SIGN_IN = ("facebook", "x", "instagram")
MEDIA = (".mp4", ".webm", ".mkv", ".mov", ".m4v", ".m4a", ".mp3")
# Phrases that tell the kind of a failure; the first kind that matches counts.
FAILURES = (
    ("no_video", ("no video could be found", "does not contain a video", "no video formats", "no video")),
    ("geo", ("not available in your country", "geo restricted", "geo-restricted", "blocked in your country")),
    ("sign_in", ("login required", "log in to", "sign in", "private", "cookies", "members-only", "requires authentication", "authentication", "confirm your age", "age-restricted", "age restricted")),
    ("unsupported", ("unsupported url", "no suitable extractor")),
    ("not_found", ("not available", "unavailable", "has been deleted", "was deleted", "removed by", "http error 404", "404 not found", "does not exist")),
)


def _parts(url: Column | str):
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    part = lambda n: F.regexp_extract(u, "(?i)^(https?)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$", n)
    return part(1), part(2), part(3), part(4)


def normal_url(url: Column | str) -> Column:
    """An http(s) address with its scheme in lower case and no fragment; null for others and for ones with credentials."""
    scheme, host, path, query = _parts(url)
    return F.when((scheme != "") & (host != "") & ~host.contains("@"), F.concat(F.lower(scheme), F.lit("://"), host, path, query))


def platform(url: Column | str) -> Column:
    """Platform of the host or one of its parents, else 'direct' for a media file, else 'other'."""
    _, authority, path, _ = _parts(url)
    host = F.lower(F.regexp_replace(authority, ":\\d*$", ""))
    found = F.when(normal_url(url).isNull(), F.lit("other"))
    for name, hosts in PLATFORMS.items():
        for h in hosts:
            found = found.when((host == h) | host.endswith("." + h), F.lit(name))
    media = F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1)).isin(*MEDIA)
    return found.when(media, F.lit("direct")).otherwise(F.lit("other"))


def needs_sign_in(name: Column | str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).isin(*SIGN_IN)


def failure_kind(message: Column | str) -> Column:
    """Kind of a failure by the first rule with a phrase in it, else 'generic'."""
    text = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    found = None
    for kind, phrases in FAILURES:
        hit = text.rlike("|".join(p.replace("-", "\\-") for p in phrases))
        found = F.when(hit, F.lit(kind)) if found is None else found.when(hit, F.lit(kind))
    return found.otherwise(F.lit("generic"))


FORMAT = "struct<url: string, vcodec: string, acodec: string>"
INFO = f"struct<_type: string, url: string, acodec: string, requested_formats: array<{FORMAT}>, is_live: boolean, age_limit: int, title: string, duration: double>"
FULL = INFO[:-1] + f", entries: array<{INFO}>>"


def stream_plan(info_json: Column | str) -> Column:
    """mode ('http', 'mux' or null if nothing can be played), url, video_url, audio_url, has_audio of a description.

    Of a list the first entry counts; separate video and audio addresses must be joined.
    """
    text = F.col(info_json) if isinstance(info_json, str) else info_json
    full = F.from_json(text, FULL)
    first = F.get(F.filter(full["entries"], lambda e: e.isNotNull()), F.lit(0))
    is_list = F.coalesce(full["_type"].isin("playlist", "multi_video"), F.lit(False)) | (F.coalesce(F.size(full["entries"]), F.lit(0)) > 0)
    pick = lambda name: F.when(is_list, first[name]).otherwise(full[name])
    formats = F.coalesce(pick("requested_formats"), F.array().cast(f"array<{FORMAT}>"))
    has = lambda c: c.isNotNull() & (c != "none")
    video = F.get(F.filter(formats, lambda f: has(f["vcodec"])), F.lit(0))
    audio = F.get(F.filter(formats, lambda f: ~has(f["vcodec"]) & has(f["acodec"])), F.lit(0))
    some = lambda c: F.coalesce(c, F.lit(""))
    v, a = some(video["url"]), some(audio["url"])
    mux = (v != "") & (a != "") & (v != a)
    url = F.when(mux, F.lit("")).when(some(pick("url")) != "", pick("url")).otherwise(v)
    sound = mux | F.exists(formats, lambda f: has(f["acodec"])) | has(pick("acodec"))
    mode = F.when(mux, F.lit("mux")).when(url != "", F.lit("http"))
    return F.struct(mode.alias("mode"), url.alias("url"), v.alias("video_url"), a.alias("audio_url"), sound.alias("has_audio"))


def single_video(info_json: Column | str) -> Column:
    """Whether a description is of one recorded video open to all ages; false for what is null or no JSON."""
    text = F.col(info_json) if isinstance(info_json, str) else info_json
    full = F.from_json(text, FULL)
    listed = full["_type"].isin("playlist", "multi_video") | (F.size(full["entries"]) > 0)
    # What can't be parsed is a structure of nulls, not null.
    return F.try_parse_json(text).isNotNull() & ~F.coalesce(listed, F.lit(False)) & ~F.coalesce(full["is_live"], F.lit(False)) & (F.coalesce(full["age_limit"], F.lit(0)) < 18)

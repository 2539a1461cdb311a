"""Landed provider payloads (JSON text) to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = ("provider string, operation string, rank int, external_id string, name string, url string, "
        "description string, owner string, country string, size bigint, extra map<string,string>")
SNIPPET = "title:string,channelTitle:string,description:string,publishedAt:string,country:string"
SHAPES = {
    ("web_search", "brave"): "web struct<results:array<struct<url:string,title:string,description:string>>>",
    ("web_search", "google"): "items array<struct<link:string,title:string,snippet:string>>",
    ("youtube", "channels"): f"items array<struct<id:struct<channelId:string>,snippet:struct<{SNIPPET}>>>",
    ("youtube", "playlists"): f"items array<struct<id:struct<playlistId:string>,snippet:struct<{SNIPPET}>>>",
    ("youtube", "channel"): f"items array<struct<id:string,snippet:struct<{SNIPPET}>,"
                            "statistics:struct<subscriberCount:string,videoCount:string>>>",
    ("musicbrainz", "recordings"): "recordings array<struct<id:string,title:string,length:bigint,score:int,"
                                   "`artist-credit`:array<struct<name:string>>>>",
    ("spotify", "tracks"): "tracks struct<items:array<struct<id:string,uri:string,name:string,explicit:boolean,"
                           "duration_ms:bigint,external_urls:struct<spotify:string>,external_ids:struct<isrc:string>>>>",
    ("soundcloud", "playlists"): "collection array<struct<id:string,title:string,description:string,permalink_url:string,"
                                 "track_count:bigint,genre:string,user:struct<username:string,permalink_url:string>>>",
    ("soundcloud", "users"): "collection array<struct<id:string,username:string,description:string,"
                             "permalink_url:string,followers_count:bigint,city:string,country:string>>",
    ("mixcloud", "users"): "data array<struct<key:string,name:string,url:string,city:string,country:string,"
                           "follower_count:bigint,biog:string>>",
    ("mixcloud", "shows"): "data array<struct<key:string,name:string,url:string,created_time:string,"
                           "tags:array<struct<name:string>>,user:struct<name:string,url:string>>>",
    ("listenbrainz", "popularity"): "payload array<struct<recording_mbid:string,total_listen_count:bigint,"
                                    "total_user_count:bigint>>",
}
# where the items sit, then column -> expression on one item
FIELDS = {
    ("web_search", "brave"): ("web.results", {"url": "url", "name": "title", "description": "description"}),
    ("web_search", "google"): ("items", {"url": "link", "name": "title", "description": "snippet"}),
    ("youtube", "channels"): ("items", {
        "external_id": "id.channelId", "name": "coalesce(item.snippet.channelTitle, item.snippet.title)",
        "description": "snippet.description",
        "url": "concat('https://www.youtube.com/channel/', item.id.channelId)"}),
    ("youtube", "playlists"): ("items", {
        "external_id": "id.playlistId", "name": "snippet.title", "description": "snippet.description",
        "owner": "snippet.channelTitle",
        "url": "concat('https://www.youtube.com/playlist?list=', item.id.playlistId)"}),
    ("youtube", "channel"): ("items", {
        "external_id": "id", "name": "snippet.title", "description": "snippet.description",
        "country": "snippet.country", "url": "concat('https://www.youtube.com/channel/', item.id)",
        "size": "try_cast(item.statistics.subscriberCount AS bigint)"}),
    ("musicbrainz", "recordings"): ("recordings", {
        "external_id": "id", "name": "title", "size": "length",
        "owner": "array_join(item.`artist-credit`.name, ', ')"}),
    ("spotify", "tracks"): ("tracks.items", {
        "external_id": "id", "name": "name", "url": "external_urls.spotify", "size": "duration_ms"}),
    ("soundcloud", "playlists"): ("collection", {
        "external_id": "id", "name": "title", "description": "description", "url": "permalink_url",
        "owner": "user.username", "size": "track_count"}),
    ("soundcloud", "users"): ("collection", {
        "external_id": "id", "name": "username", "description": "description", "url": "permalink_url",
        "country": "country", "size": "followers_count"}),
    ("mixcloud", "users"): ("data", {
        "external_id": "key", "name": "name", "url": "url", "description": "biog", "country": "country",
        "size": "follower_count"}),
    ("mixcloud", "shows"): ("data", {
        "external_id": "key", "name": "name", "url": "url", "owner": "user.name",
        "description": "array_join(item.tags.name, ', ')"}),
    ("listenbrainz", "popularity"): ("payload", {
        "external_id": "recording_mbid", "size": "total_listen_count"}),
}
COLUMNS = {"external_id": "string", "name": "string", "url": "string", "description": "string",
           "owner": "string", "country": "string", "size": "bigint"}
RESTRICTED = {"spotify": "Content from Spotify. Attribution and links required."}


def payload_items(landed: DataFrame, provider: str, operation: str) -> DataFrame:
    """Items of one provider operation, ranked by place, with provenance columns.

    ``landed`` has ``payload_id, provider, operation, payload``.  A payload that
    does not parse, or holds no items, gives no rows.
    """
    place, fields = FIELDS[provider, operation]
    parsed = (landed.filter((F.col("provider") == provider) & (F.col("operation") == operation))
              .withColumn("__p", F.from_json("payload", SHAPES[provider, operation])))
    rows = parsed.select("payload_id", "provider", "operation", F.posexplode(f"__p.{place}").alias("__pos", "item"))

    def value(name: str) -> Column:
        path = fields.get(name)
        if path is None:
            return F.lit(None).cast(COLUMNS[name])
        return F.expr(path if "(" in path else f"item.{path}").cast(COLUMNS[name])

    limited = provider in RESTRICTED
    return rows.select(
        "payload_id", "provider", "operation", (F.col("__pos") + 1).alias("rank"),
        *[value(c).alias(c) for c in COLUMNS],
        F.lit(limited).alias("restricted"), F.lit(not limited).alias("may_send_to_llm"),
        F.lit(not limited).alias("may_resolve_contacts"),
        F.lit(RESTRICTED.get(provider)).cast("string").alias("attribution"))


def placement_position(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Place of a track in a playlist read page by page.

    ``pages(playlist_id, offset, track_ids)``, ``wanted(playlist_id, track_id)``.
    Not found means not observed; it never means removed.
    """
    seen = pages.select("playlist_id", "offset", F.posexplode("track_ids").alias("__pos", "track_id"))
    hits = (seen.join(wanted, ["playlist_id", "track_id"], "left_semi")
            .groupBy("playlist_id", "track_id")
            .agg(F.min(F.col("offset") + F.col("__pos") + 1).alias("position")))
    return (wanted.join(hits, ["playlist_id", "track_id"], "left")
            .withColumn("observed", F.col("position").isNotNull()))

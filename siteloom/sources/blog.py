"""Schemas of a blog's tables. Timestamps are in seconds or milliseconds in the source and timestamps here."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import complete, struct_of

POSTS = struct_of("id bigint, slug string, title string, excerpt string, content string, key_takeaways string, faqs string, cover_image_key string, cover_image_alt string, author_id bigint, "
                  "category string, meta_title string, meta_description string, reading_time int, view_count bigint, featured boolean, status string, published_at bigint, created_at bigint, updated_at bigint")
CATEGORIES = struct_of("id bigint, slug string, name string")
SETTINGS = struct_of("key string, value string")
USERS = struct_of("id bigint, username string, password_hash string, role string, display_name string, avatar_key string, job_title string, bio string, website string, email string, github string, "
                  "twitter string, linkedin string, facebook string, login_email string, password_changed_at bigint, created_at bigint")
COMMENTS = struct_of("id bigint, post_id bigint, parent_id bigint, user_id bigint, author_name string, content string, ip_hash string, status string, created_at bigint")
VOTES = struct_of("id bigint, comment_id bigint, voter_key string, value int, created_at bigint")
LOGIN_ATTEMPTS = struct_of("id bigint, ip_hash string, attempted_at bigint")
TABLES = {"posts": POSTS, "categories": CATEGORIES, "settings": SETTINGS, "users": USERS, "comments": COMMENTS, "comment_votes": VOTES, "login_attempts": LOGIN_ATTEMPTS}
#: Columns that are unique together.
UNIQUE = {"posts": ("slug",), "categories": ("slug",), "settings": ("key",), "users": ("username",), "comment_votes": ("comment_id", "voter_key")}


def table(df, name: str):
    """df with the columns and types of a table; its *_at columns as timestamps."""
    schema: T.StructType = TABLES[name]
    out = complete(df, schema)
    milli = {"password_changed_at"}
    return out.withColumns({f.name: F.timestamp_millis(f.name) if f.name in milli else F.timestamp_seconds(f.name) for f in schema.fields if f.name.endswith("_at")} or {"__": F.lit(None)}).drop("__")


def repeated_keys(df, name: str):
    """Values of a table's unique columns that several rows have, with their number."""
    return df.groupBy(*UNIQUE[name]).agg(F.count("*").alias("n")).where("n > 1")

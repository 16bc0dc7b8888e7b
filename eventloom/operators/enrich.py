"""Organiser contacts and announcement links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.patterns import blank_to_null, contains_any, extract, first_label, matches, replace, text
from ..functions.text import ascii_digits
from .contains import digest, first_contained


def _image(address: Column, suffixes=lx.IMAGE_SUFFIXES) -> Column:
    """One pattern, so that the address is looked for once."""
    return F.lower(address).rlike("(?:" + "|".join(x.replace(".", r"\.") for x in suffixes) + r")\z")


def caption_contacts(caption: Column) -> Column:
    """E-mail, phone and handle written in a caption, as a struct."""
    norm = ascii_digits(caption)
    email = F.when(norm.contains("@"), extract(norm, lx.CAPTION_EMAIL, ignore_case=False))
    phone = F.regexp_replace(extract(norm, lx.CAPTION_PHONE, ignore_case=False), r"[\s\-]+", "")
    handle = F.when(contains_any(norm, ("@", "instagram.com/")), extract(replace(norm, lx.CAPTION_EMAIL, " ", ignore_case=False), lx.CAPTION_HANDLE, 1, ignore_case=False))
    return F.struct(F.when(~_image(email), email).alias("email"), phone.alias("phone"),
                    F.when(~F.lower(handle).isin(*lx.RESERVED_HANDLES), handle).alias("instagram"))


def text_contacts(body: Column) -> Column:
    """The variant for descriptions: also LinkedIn pages, and handles that look like domains refused."""
    email = extract(body, lx.TEXT_EMAIL, ignore_case=False)
    handle = F.regexp_replace(extract(replace(body, lx.TEXT_EMAIL, " ", ignore_case=False), lx.TEXT_HANDLE, 1,
                                      ignore_case=False), r"^[. ]+|[. ]+$", "")
    fine = ~F.lower(handle).isin(*lx.MAIL_HOST_HANDLES) & ~matches(handle, r"\.(com|org|net|edu|gov|eg)$")
    page = extract(body, lx.TEXT_LINKEDIN, 1, ignore_case=False)
    return F.struct(F.when(~_image(email), email).alias("email"),
                    extract(body, lx.TEXT_PHONE, ignore_case=False).alias("phone"),
                    F.concat(F.lit("company/"), page).alias("linkedin"), F.when(fine, handle).alias("instagram"))


def directory_key(hay: Column, directory=lx.DIRECTORY) -> Column:
    """Key of the first directory entry named in the text."""
    return first_label(hay, [(d[0], (d[0],)) for d in directory], F.lit(None).cast("string"))


def _directory_map(directory) -> Column:
    pairs = []
    for key, email, instagram, linkedin, phone in directory:
        pairs += [F.lit(key), F.struct(*(F.lit(v).cast("string").alias(n) for n, v in (
            ("email", email), ("instagram", instagram), ("linkedin", linkedin), ("phone", phone))))]
    return F.create_map(*pairs)


def _with_entry(df: DataFrame, hay: Column, directory) -> DataFrame:
    """``df`` with the struct _d of the first directory entry whose key the text contains."""
    if not isinstance(directory, DataFrame):  # a short list becomes an expression
        return df.withColumn("_key", directory_key(hay, directory)).withColumn("_d", F.element_at(_directory_map(directory), F.col("_key")))
    rows = df.withColumn("_hay", hay)
    entries = first_contained(rows.select(F.col("_hay").alias("text")), directory)
    kept = [n for n in ("email", "instagram", "linkedin", "phone", "name") if n in directory.columns]
    entry = F.struct(*(F.col(n).cast("string").alias(n) for n in kept))
    return rows.withColumn("_t", digest(F.col("_hay"))).join(entries.select(F.col("t").alias("_t"), F.col("key").alias("_key"), entry.alias("_d")), "_t", "left").drop("_t", "_hay")


def enrich_contacts(df: DataFrame, directory=lx.DIRECTORY) -> DataFrame:
    """Fill missing contacts from the directory, then from the text; choose the announcement link.

    ``directory``: a short list of (key, email, instagram, linkedin, phone) in order, or a frame of any size with these columns and ord.
    """
    keep, c = df.columns, F.col
    hay = F.lower(F.concat_ws(" ", *(text(c(x)) for x in (
        "title", "organizer", "description", "raw_caption", "parallel_org"))))
    body = F.concat_ws(" ", text(c("description")), text(c("raw_caption")))
    df = _with_entry(df, hay, directory).withColumn("_x", text_contacts(body))

    def fill(own: str, name: str) -> Column:
        return F.coalesce(blank_to_null(c(own)), c(f"_d.{name}"), c(f"_x.{name}"))

    post, source = blank_to_null(c("post_direct_url")), text(c("source"))
    best = F.coalesce(post, blank_to_null(c("organizer_profile_url")), blank_to_null(c("url")),
                      F.lit("https://facebook.com/events"))
    proof = blank_to_null(c("proof_url"))
    kind, evidence = blank_to_null(c("proof_type")), blank_to_null(c("proof_evidence"))
    return df.withColumns({
        "organizer_email": fill("organizer_email", "email"),
        "organizer_phone": fill("organizer_phone", "phone"),
        "organizer_linkedin": fill("organizer_linkedin", "linkedin"),
        "organizer_instagram": fill("organizer_instagram", "instagram"),
        "proof_url": F.when(proof.isNull() | F.lower(proof).contains("search"), best)
        .when(post.isNotNull(), post).otherwise(proof),
        "proof_type": F.when(post.isNotNull(), "Direct Social Announcement Post")
        .when(kind.isNotNull() & (kind != "Official Announcement"), kind)
        .when(F.lower(source).contains("ticket"), "Ticket Feed Listing")
        .otherwise("Official Organizer Announcement"),
        "proof_evidence": F.when(post.isNotNull(), F.concat(
            F.lit("Direct announcement post via "), F.coalesce(blank_to_null(source), F.lit("Social Channel"))))
        .otherwise(F.coalesce(evidence, F.concat(
            F.lit("Public event listing via "),
            F.coalesce(blank_to_null(source), F.lit("Official Channel"))))),
    }).select(*keep)


def enrich_client(df: DataFrame, directory=lx.DIRECTORY, names=lx.DIRECTORY_NAMES) -> DataFrame:
    """Client variant: organiser label filled too (a frame has it as name), no LinkedIn extraction, phones without blanks."""
    keep, c = df.columns, F.col
    hay = F.lower(F.concat_ws(" ", *(text(c(x)) for x in ("title", "organizer", "description", "parallel_org"))))
    body = text(c("description"))
    if isinstance(directory, DataFrame):
        df = _with_entry(df, hay, directory.withColumn("phone", F.replace("phone", F.lit(" "), F.lit(""))))
        df = df.withColumn("_name", c("_d.name"))
    else:
        tight = [(k, e, i, li, p.replace(" ", "") if p else None) for k, e, i, li, p in directory]
        label = F.create_map(*[F.lit(v) for pair in names for v in pair])
        df = _with_entry(df, hay, tight).withColumn("_name", F.element_at(label, c("_key")))
    email = extract(body, lx.CAPTION_EMAIL, ignore_case=False)
    handle = extract(replace(body, lx.CAPTION_EMAIL, " ", ignore_case=False), lx.CAPTION_HANDLE, 1, ignore_case=False)
    fine = ~F.lower(handle).isin(*lx.MAIL_HOST_HANDLES) & ~matches(handle, r"\.(com|org|net|edu|gov|eg)$")
    own = F.coalesce(blank_to_null(c("organizer")), F.lit("Organizing Committee"))

    def fill(col: str, name: str, found: Column) -> Column:
        return F.coalesce(blank_to_null(c(col)), c(f"_d.{name}"), found)

    return df.withColumns({
        "organizer": F.when(own == "Organizing Committee", F.coalesce("_name", own)).otherwise(own),
        "organizer_email": fill("organizer_email", "email", F.when(~_image(email, (".png", ".jpg")), email)),
        "organizer_phone": fill("organizer_phone", "phone", extract(body, lx.TEXT_PHONE, ignore_case=False)),
        "organizer_linkedin": F.coalesce(blank_to_null(c("organizer_linkedin")), c("_d.linkedin")),
        "organizer_instagram": fill("organizer_instagram", "instagram", F.when(fine, handle)),
    }).select(*keep)


def contact_addresses(df: DataFrame, column: str = "organizer_email") -> DataFrame:
    """Distinct addresses for a broadcast list, one per row so that the list may be of any length."""
    return df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()

"""Synthetic annotated samples and label, language and country draws, all keyed by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.dummies import generate_dummy, hash_draw, words
from pii_spark.functions.offsets import compute_once, let, running_totals

SLOT = r"\{[A-Z]+\}"

# Sentences with {LABEL} slots; together they use every standard label.
TEMPLATES = [
    "Hello, this is {FIRSTNAME} {SURNAME} from {CITY}.",
    "Please send the contract to {EMAIL} before Friday.",
    "You can reach {FIRSTNAME} under {PHONENUMBER} all day.",
    "The invoice goes to {COMPANYNAME}, {BUILDINGNUM} {STREET}, {CITY}, {STATE} {ZIP}.",
    "Her social security number {SSN} was sent by mistake.",
    "Charge card {CREDITCARDNUMBER} for {FIRSTNAME} {SURNAME}.",
    "Log in as {USERNAME} with the password {PASSWORD} today.",
    "{FIRSTNAME} {SURNAME}, born {DATEOFBIRTH}, asked for a refund.",
    "Transfer the deposit to {IBAN} in {COUNTRY}.",
    "Passport {PASSPORTID} belongs to {SURNAME}, {FIRSTNAME}.",
    "The driver showed license {DRIVERLICENSENUM} and plate {LICENSEPLATENUM}.",
    "National id {NATIONALID} and card {IDCARDNUM} do not match.",
    "Our tax number is {TAXNUM}, please update your files.",
    "See {URL} for the account of {USERNAME}.",
    "My daughter is {AGE} and lives in {STREET}, {CITY}.",
    "Rotate the key {SECURITYTOKEN} right away.",
    "{COMPANYNAME} hired {FIRSTNAME} {SURNAME} in {STATE}.",
    "Ship it to {BUILDINGNUM} {STREET}, {ZIP} {CITY}, {COUNTRY}.",
    "Dear {SURNAME}, your number {PHONENUMBER} is already on file with {EMAIL}.",
    "The patient, {AGE}, gave {SSN} and {DATEOFBIRTH} at the desk.",
    "Renew {PASSPORTID} and {DRIVERLICENSENUM} before you move to {COUNTRY}.",
    "Plate {LICENSEPLATENUM} was seen near {STREET} in {CITY}.",
    "Use {IBAN} or card {CREDITCARDNUMBER}, as you like.",
    "Forward {URL} to {EMAIL} and copy {FIRSTNAME}.",
    "Employee {IDCARDNUM} of {COMPANYNAME} lost a badge.",
    "Tax file {TAXNUM} of {FIRSTNAME} {SURNAME} is closed.",
    "The token {SECURITYTOKEN} was issued to {USERNAME}.",
    "Reset {PASSWORD} for {EMAIL} now!",
    "Citizen {NATIONALID} moved from {STATE} to {COUNTRY}.",
    "Write to {FIRSTNAME} {SURNAME}, {ZIP} {CITY}.",
]


def pick_from(pool: list[str], draw: Column) -> Column:
    return F.get(words(pool), (draw % len(pool)).cast("int"))


def synthesize(
    ids: DataFrame, key: str, salt: str = "42", templates: list[str] = TEMPLATES, before: str | None = None
) -> DataFrame:
    """One annotated sample per row of ``ids``: template by hash, slots filled with dummies.

    Gives (key, text, entities) with exact offsets. With ``before``, the sentence follows the text of that
    column. Row-local, so it scales with ``ids``.
    """
    name = F.col(key).cast("string")
    seed = F.concat_ws("|", F.lit(salt), name)
    template = pick_from(templates, hash_draw(seed, 0))

    def fill(t: Column) -> Column:
        slots = F.transform(
            F.regexp_extract_all(t, F.lit(SLOT), F.lit(0)), lambda s: F.translate(s, "{}", "")
        )
        values = F.transform(
            slots,
            lambda label, i: F.struct(
                label.alias("label"),
                generate_dummy(label, F.concat(name, F.lit("#"), i.cast("string")), salt).alias("value"),
            ),
        )
        return F.struct(values.alias("values"), F.split(t, SLOT, -1).alias("gaps"))

    def build(f: Column) -> Column:
        filled, gaps = f["values"], f["gaps"]
        steps = F.zip_with(
            filled, F.slice(gaps, F.lit(1), F.size(filled)),
            lambda v, g: F.length(v["value"]) + F.length(g),
        )
        pieces = F.transform(filled, lambda v, i: F.concat(F.get(gaps, i), v["value"]))
        return let(
            running_totals(steps, short=True),
            lambda ends: F.struct(
                F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1)).alias("text"),
                F.transform(
                    filled,
                    lambda v, i: F.struct(
                        v["value"].alias("text"), v["label"].alias("label"),
                        (F.get(ends, i) - F.length(v["value"])).alias("start"),
                        F.get(ends, i).alias("end"), F.lit(1.0).alias("confidence"),
                    ),
                ).alias("entities"),
            ),
        )

    sample = let(let(template, fill), build)
    if before is None:
        return ids.select(key, sample.alias("s")).select(key, "s.text", "s.entities")
    made = compute_once(ids.select(key, F.coalesce(before, F.lit("")).alias("_before")), "_s", sample)
    shift = F.length("_before") + 1
    moved = F.transform("_s.entities", lambda e: F.struct(
        e["text"].alias("text"), e["label"].alias("label"), (e["start"] + shift).alias("start"),
        (e["end"] + shift).alias("end"), e["confidence"].alias("confidence"),
    ))
    return made.select(key, F.concat("_before", F.lit(" "), "_s.text").alias("text"), moved.alias("entities"))


def sample_id(number: Column) -> Column:
    """``s0007``-style names; longer numbers keep all digits."""
    digits = number.cast("string")
    return F.concat(F.lit("s"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def label_coverage(samples: DataFrame, labels_dim: DataFrame, minimum: int = 5) -> DataFrame:
    """Count per standard label, zero included, and whether it falls below ``minimum``."""
    counts = (
        samples.select(F.explode_outer("entities.label").alias("label"))
        .where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("c"))
    )
    n = F.coalesce("c", F.lit(0))
    return labels_dim.join(counts, "label", "left").select(
        "label", n.alias("n"), (n < minimum).alias("under_represented")
    )


def sample_labels(ids: DataFrame, key: str, n: int = 10, salt: str = "42") -> DataFrame:
    """``n`` labels per row, weighted and without replacement; one address label brings all six.

    Each label gets the key -ln(u) / weight and the ``n`` smallest keys win, inside the row.
    """
    seed = F.concat_ws("|", F.lit(salt), F.col(key).cast("string"))
    dim = F.array(*[
        F.struct(F.lit(label).alias("label"),
                 F.lit(fv.LABEL_CHANCE.get(label, fv.DEFAULT_CHANCE)).alias("w"))
        for label in fv.STANDARD_LABELS
    ])
    keyed = let(
        seed,
        lambda s: F.transform(
            dim,
            lambda d: F.struct(
                (-F.ln((hash_draw(F.concat_ws("|", s, d["label"]), 0) + 1) / F.lit(4294967297.0)) / d["w"]).alias("k"),
                d["label"].alias("label"),
            ),
        ),
    )
    address = F.array(*[F.lit(a) for a in fv.ADDRESS_LABELS])
    drawn = F.transform(F.slice(F.array_sort(keyed), 1, n), lambda k: k["label"])
    closed = let(
        drawn,
        lambda ls: F.array_sort(
            F.when(F.arrays_overlap(ls, address), F.array_union(ls, address)).otherwise(ls)
        ),
    )
    return ids.select(key, closed.alias("labels"))


def sample_language_country(ids: DataFrame, key: str, salt: str = "42") -> DataFrame:
    """A language per row, and one of its countries."""
    seed = F.concat_ws("|", F.lit(salt), F.col(key).cast("string"))
    languages = list(fv.LANGUAGE_COUNTRIES)
    out = ids.withColumn("language", pick_from(languages, hash_draw(seed, 1)))
    draw = hash_draw(seed, 2)
    country = None
    for language, pool in fv.LANGUAGE_COUNTRIES.items():
        hit = F.col("language") == language
        value = pick_from(pool, draw)
        country = F.when(hit, value) if country is None else country.when(hit, value)
    return out.withColumn("country", country)

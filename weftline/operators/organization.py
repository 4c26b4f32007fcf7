"""An organization chart and a customer list joined to the graph: edges exist only where both of their ends do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: A name that the summary could not read. Fixed value.
UNREAD = "(未识别)"
_EDGE = ("rel_type", "src", "dst", "assigned_date", "involvement_type")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _place(*more: str) -> Column:
    """The order of entries: their place in the document, then (for documents in lines, which have none) their values."""
    return F.struct("seq", *more)


def users(org: dict[str, DataFrame], variants: dict[str, str] | None = None) -> DataFrame:
    """Users with an id and a name, and the person that each is: the normalised name, else (a role word) the id."""
    named = org["users"].where(_filled("id")).withColumn("trimmed", X.strip(F.coalesce("name", F.lit("")))).where("trimmed <> ''")
    normal = named.withColumn("normal", X.person_name(F.col("trimmed"), variants))
    return normal.withColumn("person", F.coalesce("normal", "id")).withColumn("name", F.coalesce("normal", "trimmed")).drop("trimmed", "normal")


def person_of(rows: DataFrame) -> DataFrame:
    """(user_id, person): of entries that repeat an id the last counts."""
    return rows.groupBy(F.col("id").alias("user_id")).agg(F.max_by("person", _place("person")).alias("person"))


def people(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(person, name, email, department, role, is_from_email): several users of one name are one person, of whom each
    property keeps its first value; people known from events (a column person) stay so and get what the chart adds."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), _place("id"))).alias(c)
    chart = rows.groupBy("person").agg(*[first(c) for c in ("name", "email", "department", "role")])
    if known is None:
        return chart.withColumn("is_from_email", F.lit(False))
    seen = known.select("person").where(F.col("person").isNotNull()).distinct().withColumn("seen", F.lit(True))
    both = chart.join(seen, "person", "full")
    return both.select("person", F.coalesce("name", "person").alias("name"), "email", "department", "role", F.coalesce("seen", F.lit(False)).alias("is_from_email"))


def departments(org: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """(dept_id, name, manager_id, member_count): the first entry of an id counts; members are users that name it."""
    listed = org["departments"].where(_filled("id"))
    one = listed.groupBy(F.col("id").alias("dept_id")).agg(F.min_by(F.struct("name", "manager"), _place("name", "manager")).alias("d"))
    members = rows.where(_filled("department")).groupBy(F.col("department").alias("dept_id")).agg(F.count(F.lit(1)).alias("member_count"))
    return one.join(members, "dept_id", "left").select("dept_id", "d.name", F.col("d.manager").alias("manager_id"), F.coalesce("member_count", F.lit(0)).alias("member_count"))


def _edges(rows: DataFrame, rel_type: str, src: str, dst: str, **props: Column) -> DataFrame:
    more = [props.get(c, F.lit(None).cast("string")).alias(c) for c in _EDGE[3:]]
    return rows.select(F.lit(rel_type).alias("rel_type"), F.col(src).alias("src"), F.col(dst).alias("dst"), *more)


def edges(org: dict[str, DataFrame], rows: DataFrame, styles: DataFrame) -> DataFrame:
    """(rel_type, src, dst, assigned_date, involvement_type), unique in its first three. styles has a column style_id.

    BELONGS_TO_DEPT, REPORTS_TO and MANAGES from the chart; RESPONSIBLE_FOR and INVOLVED_IN from its assignments, whose
    lists are exploded. An end that is no department, user or style drops the edge by a join, each on its own key. Of
    edges between the same two ends the last counts: later assignments, and watchers over secondary owners.
    """
    persons = person_of(rows)
    as_user = lambda df, key, name: df.join(persons.select(F.col("user_id").alias(key), F.col("person").alias(name)), key)
    depts = org["departments"].where(_filled("id")).select(F.col("id").alias("department")).distinct()
    member = rows.join(depts, "department", "left_semi")
    reports = as_user(as_user(rows.where(_filled("reports_to")).select(F.col("id").alias("own"), "reports_to"), "own", "who"), "reports_to", "boss")
    manages = as_user(org["departments"].where(_filled("id") & _filled("manager")).select("id", "manager"), "manager", "who")

    known = styles.select(F.col("style_id").cast("string").alias("style_id")).distinct()
    assigned = org["style_assignments"].where(_filled("style_id")).join(known, "style_id", "left_semi")
    primary = as_user(assigned, "primary_owner", "who").groupBy("who", "style_id").agg(F.max_by(F.coalesce("assigned_date", F.lit("")), _place("assigned_date")).alias("assigned_date"))
    ranked = lambda c, k: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda u: F.struct(u.alias("user"), F.lit(k).alias("rank")))
    roles = F.explode(F.concat(ranked("secondary_owners", 0), ranked("watchers", 1)))
    others = as_user(assigned.select("style_id", "seq", roles.alias("r")).select("style_id", "seq", "r.*"), "user", "who")
    involved = others.groupBy("who", "style_id").agg(F.max_by(F.when(F.col("rank") == 1, "watcher").otherwise("secondary_owner"), F.struct("seq", "rank")).alias("kind"))

    parts = [
        _edges(member, "BELONGS_TO_DEPT", "person", "department").distinct(), _edges(reports, "REPORTS_TO", "who", "boss").distinct(), _edges(manages, "MANAGES", "who", "id").distinct(),
        _edges(primary, "RESPONSIBLE_FOR", "who", "style_id", assigned_date=F.col("assigned_date")), _edges(involved, "INVOLVED_IN", "who", "style_id", involvement_type=F.col("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def customers(members: DataFrame, sources: list[str]) -> DataFrame:
    """(email, name, source) of the members (company, email, name, seq) of the companies in sources, one row an address.

    Sources come in order of precedence: an address that several have is the first one's, and within a company its
    first entry counts. A name that is blank or unread is the address's local part.
    """
    email, name = F.lower(X.strip(F.coalesce("email", F.lit("")))), X.strip(F.coalesce("name", F.lit("")))
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("company"))
    own = members.where(F.col("company").isin(sources)).select(email.alias("email"), name.alias("given"), "company", "seq", rank.alias("rank")).where("email <> ''")
    first = own.groupBy("email").agg(F.min_by(F.struct("given", "company"), F.struct("rank", "seq", "given")).alias("m"))
    named = F.when((F.col("m.given") != "") & (F.col("m.given") != UNREAD), F.col("m.given")).otherwise(F.substring_index("email", "@", 1))
    return first.select("email", named.alias("name"), F.col("m.company").alias("source"))


def customer_styles(found: DataFrame, mailed: DataFrame, styles: DataFrame) -> dict[str, DataFrame]:
    """What customers' mail (email, style_id) says: `edges` to styles that are known, in both directions, `customers` with
    all their styles, unknown ones too, and `styles` with their number of customers."""
    own = mailed.where(_filled("style_id")).select(F.lower("email").alias("email"), "style_id").join(found.select("email"), "email", "left_semi").distinct()
    known = own.join(styles.select(F.col("style_id").cast("string").alias("style_id")).distinct(), "style_id", "left_semi")
    both = F.inline(F.array(F.struct(F.lit("HAS_STYLE").alias("rel_type"), F.col("email").alias("src"), F.col("style_id").alias("dst")), F.struct(F.lit("ORDERED_BY").alias("rel_type"), F.col("style_id").alias("src"), F.col("email").alias("dst"))))
    counted = found.join(own.groupBy("email").agg(F.count(F.lit(1)).alias("style_count")), "email", "left").select("email", "name", "source", F.coalesce("style_count", F.lit(0)).alias("style_count"))
    return {"edges": known.select(both), "customers": counted, "styles": known.groupBy("style_id").agg(F.count(F.lit(1)).alias("customer_count"))}

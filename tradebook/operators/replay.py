"""A batch of project events applied one after the other, without going one by one.

Three facts make this a set computation:

* a reference keeps the target its first event gave it, so whether a later event is stale depends
  on the events of that reference alone (a running maximum);
* only the first event of a reference nobody holds looks for a customer by e-mail or phone;
* what that event finds depends on earlier first events only.

So the targets of new references are the one fixed point of "look up each e-mail and phone among
the customers as they would be at that moment, given the targets so far". Each round settles at
least the next reference in time, usually all of them within a few rounds, and the loop ends only
when a round changes nothing. The first round looks everything up; a later one works out anew only
the customers whose events came or went in the round before, and looks up again only the keys whose
holders that changed. What a round works out is written once and read by later ones.

The tables are reached through a `Snapshot`: the records that hold the keys of the events, and whole
rows by id. So a stream can answer from a table of keys and from the parts of its tables concerned.

"The customers as they would be at that moment" is a set of intervals (this customer had this
e-mail from here to there). An interval is cut into the few aligned blocks that cover it, a
moment lies in one block of every size, so the lookup is an equality join on (key, block) to a
table with one row per key and block. No pairs of events and customers are formed, also for an
e-mail that most of the rows share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import (
    derive_stage, parsed, with_fields, with_nonempty_fields,
)
from ..functions.text import blank_to_null, first_nonempty
from ..schemas import DEFAULT_STAGE, DEFAULT_STATUS, EMPTY_TABS, LINK, LinkFields
from ..session import scratch_dir
from ..sources.tables import stored
from .matching import (
    EMAIL_MARK, MARKED, PHONE_MARK, REF_MARK, customer_keys, event_keys, fold_sparse_updates, holders, is_stale,
    job_keys, key_rows, spread_null,
)
from .prefix import CHUNK_BITS, NO_HOT_KEYS, hot_keys, prefix_fold
from .snapshots import ordinal

IDENTITY = ("name", "email", "phone", "address")
DEAL = ("quote_value", "installation_value", "ext_status", "modified")

# A customer is (0, id) if it was there before the batch, else (1, seq of the event that made it).
ENTITY = ["is_new", "num"]


# Number and width of the fields whose keys are looked up: (field, mark of its keys, key column).
IDENTITY_KEYS = (("e", EMAIL_MARK), ("p", PHONE_MARK))


@dataclass(frozen=True)
class Snapshot:
    """The tables before the events: rows of the look-up table for distinct `key`s, whole rows for
    distinct `id`s, and the highest ids."""

    keys: Callable[[DataFrame], DataFrame]
    jobs: Callable[[DataFrame], DataFrame]
    customers: Callable[[DataFrame], DataFrame]
    last_job: Column
    last_customer: Column


def whole_tables(jobs: DataFrame, customers: DataFrame, link: LinkFields = LINK) -> Snapshot:
    """A snapshot that reads the tables themselves."""
    def last(table: DataFrame) -> Column:
        return F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0))

    return Snapshot(
        keys=lambda asked: key_rows(job_keys(jobs, link), customer_keys(customers, link)).join(asked, "key", "left_semi"),
        jobs=lambda ids: jobs.join(ids, "id", "left_semi"),
        customers=lambda ids: customers.join(ids, "id", "left_semi"),
        last_job=last(jobs), last_customer=last(customers),
    )


@dataclass(frozen=True)
class Replayed:
    """`actions` has one row per event; the other two are whole table rows, changed or new."""

    actions: DataFrame
    jobs: DataFrame
    customers: DataFrame
    rounds: int


# ---- intervals and blocks --------------------------------------------------------------------

def _blocks(start: str, end: str, top: int) -> Column:
    """The aligned blocks (size as power of two, number) that make up [start, end)."""
    first = f"shiftright({start} + shiftleft(1L, l) - 1, l)"
    beyond = f"shiftright({end}, l)"
    left = f"{first} < {beyond} and {first} % 2 = 1"
    right = f"{first} < {beyond} and {beyond} % 2 = 1 and not ({first} % 2 = 1 and {first} = {beyond} - 1)"
    return F.expr(
        f"flatten(transform(sequence(0, {top}), l -> filter(array("
        f"if({left}, named_struct('size', l, 'block', {first}), null), "
        f"if({right}, named_struct('size', l, 'block', {beyond} - 1), null)), "
        "b -> b is not null)))"
    )



def _intervals(facts: DataFrame, top: int, bits: int, few: bool) -> DataFrame:
    """Facts `(is_new, num, field, pos, key)` with the position `until` which each holds.

    Most patches repeat what is known already, so only those that change a key are kept. With `few`
    all of them fit a chunk; otherwise they are stored and counted.
    """
    group = [*ENTITY, "field"]
    facts = facts if few else stored(facts, "facts")
    hot = NO_HOT_KEYS if few else hot_keys(facts, group, bits)
    changes = prefix_fold(facts, group, "pos", {"_was": ("last", F.col("key"))}, bits, hot).filter(
        ~F.col("key").eqNullSafe(F.col("_was"))
    )
    backwards = prefix_fold(
        changes.drop("_was").withColumn("_back", -F.col("pos")), group, "_back",
        {"until": ("last", F.col("pos"))}, bits, hot,
    )
    return backwards.select(*INTERVAL[:-1], F.coalesce("until", F.lit(2**top).cast("long")).alias("until"))


def _find(queries: DataFrame, intervals: DataFrame, top: int) -> DataFrame:
    """For every `ref_key` of `(ref_key, field, key, pos)` which fields were asked, as `asked_<field>`, and
    the first customer whose interval holds `pos`, as `new_<field>` (null: none)."""
    blocks = (
        intervals.select(*ENTITY, "key", F.explode(_blocks("pos", "until", top)).alias("_b"))
        .groupBy("key", F.col("_b.size").alias("size"), F.col("_b.block").alias("block"))
        .agg(F.min(F.struct(*ENTITY)).alias("entity"))
    )
    asked = queries.select(
        "ref_key", "field", "key", "pos", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("size")
    ).withColumn("block", F.expr("shiftright(pos, size)"))
    found = asked.join(blocks, ["key", "size", "block"]).select("ref_key", "field", "entity")
    rows = found.unionByName(queries.select("ref_key", "field"), allowMissingColumns=True)
    of_field = [(f, F.col("field") == f) for f, _ in IDENTITY_KEYS]
    return rows.groupBy("ref_key").agg(
        *[F.max(mine).alias(f"asked_{f}") for f, mine in of_field],
        *[F.min(F.when(mine, F.col("entity"))).alias(f"new_{f}") for f, mine in of_field],
    )


def _key_facts(df: DataFrame, position: Column) -> DataFrame:
    """One row per known e-mail and phone key, marked as in the look-up table."""
    pairs = F.array(*[
        F.struct(F.lit(field).alias("field"), F.concat(F.lit(mark), MARKED[mark]).alias("key"))
        for field, mark in IDENTITY_KEYS
    ])
    others = [c for c in df.columns if c in (*ENTITY, "ref_key")]
    return df.select(*others, position.cast("long").alias("pos"), F.explode(pairs).alias("_k")).select(
        *others, "pos", "_k.field", "_k.key"
    ).filter(F.col("key").isNotNull())


# ---- the fixed point -------------------------------------------------------------------------

INTERVAL = [*ENTITY, "field", "pos", "key", "until"]


class _Rounds:
    """Rows written round by round."""

    def __init__(self, label: str, schema: str):
        self.label, self.schema = label, f"{schema}, round int"
        self.folder: str | None = None

    def add(self, df: DataFrame, number: int) -> DataFrame:
        """Write a round's rows, and give them back."""
        self.folder = self.folder or scratch_dir(df.sparkSession, self.label)
        path = f"{self.folder}/round={number}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def all(self, of: DataFrame) -> DataFrame:
        return of.sparkSession.read.schema(self.schema).parquet(self.folder)


ENTITY_TYPE = "struct<is_new: int, num: bigint>"
# A reference's answers and target after a round, what the target was before, and whether it moved.
TARGET = ["first_seq", "found_e", "found_p", "entity", "was", "moved"]


class _Fixpoint:
    """The targets of new references, by rounds in which only what changed is worked out again.

    A customer is touched by a round if a target moved to or away from it in the round before: its
    intervals are then replaced. All rows of a round are kept, and those of the latest one hold.
    """

    def __init__(self, marked: DataFrame, firsts: DataFrame, base: DataFrame, top: int, bits: int, few: bool):
        """`marked` is stored; with `few` all events and `base` keys together fit a chunk."""
        self.top, self.bits, self.few = top, bits, few
        self.firsts = firsts.select("ref_key", "first_seq", "email_key", "phone_key")
        self.queries = stored(_key_facts(self.firsts, F.col("first_seq")), "queries")
        self.wanted = self.queries.select("key").distinct()
        # A customer's first state matters only where its key is asked for: nothing ends by it.
        base = base.join(self.wanted, "key", "left_semi").select(
            F.lit(0).alias("is_new"), F.col("id").alias("num"), F.lit(0).cast("long").alias("pos"),
            F.substring("key", 1, 1).alias("field"), "key",
        )
        later = marked.filter(F.col("applied") & ~(F.col("linked").isNull() & F.col("is_first")))
        settled = _key_facts(
            later.filter(F.col("patched").isNotNull()).select(
                F.lit(0).alias("is_new"), F.col("patched").alias("num"), "seq", "email_key", "phone_key"
            ), F.col("seq") + 1,
        )
        self.known = stored(base.unionByName(settled), "known")
        self.open_patches = _key_facts(
            later.filter(F.col("linked").isNull()).select("ref_key", "seq", "email_key", "phone_key"),
            F.col("seq") + 1,
        )
        self.made = _key_facts(
            self.firsts.select("ref_key", F.lit(1).alias("is_new"), F.col("first_seq").alias("num"),
                               "email_key", "phone_key"), F.col("num") + 1,
        )
        self.intervals = _Rounds("intervals", "is_new int, num long, field string, pos long, key string, until long")
        self.targets = _Rounds("targets", "ref_key string, first_seq long, " + ", ".join(
            f"{c} {ENTITY_TYPE}" for c in TARGET[1:5]) + ", moved boolean")

    def _latest(self, rows: DataFrame, *more: str) -> DataFrame:
        """Of some rows of the targets those of each reference's latest round; `more` columns are alike in all."""
        return rows.groupBy("ref_key").agg(
            F.max(F.struct("round", *TARGET)).alias("_t"), *[F.any_value(c).alias(c) for c in more]
        ).select("ref_key", *[F.col("_t")[c].alias(c) for c in TARGET], *more)

    def _touched(self, moved: DataFrame) -> DataFrame:
        """The customers that targets moved to or away from."""
        kept = [c for c in moved.columns if c == "round"]
        return moved.select(F.explode(F.array("entity", "was")).alias("_e"), *kept).select("_e.*", *kept)

    def _held(self, intervals: DataFrame, number: int) -> DataFrame:
        """Those of some intervals that hold after a round."""
        if number == 0:
            return intervals.select(*INTERVAL)
        moved = self.targets.all(intervals).filter(F.col("moved") & (F.col("round") < number))
        latest = self._touched(moved).groupBy(*ENTITY).agg((F.max("round") + 1).alias("_latest"))
        return intervals.join(latest, ENTITY, "left").filter(F.col("round") == F.coalesce("_latest", F.lit(0))).select(*INTERVAL)

    def _replace(self, facts: DataFrame, number: int) -> DataFrame:
        held = _intervals(facts, self.top, self.bits, self.few).join(self.wanted, "key", "left_semi")
        return self.intervals.add(held.select(*INTERVAL), number)

    def _first_round(self) -> DataFrame:
        """Everything looked up as if each new reference made a customer; the references that found one."""
        own = F.struct(F.lit(1).alias("is_new"), F.col("first_seq").alias("num"))
        as_makers = self.firsts.select("ref_key", own.alias("_e")).select("ref_key", "_e.*")
        facts = self.known.unionByName(self.made.drop("ref_key")).unionByName(
            self.open_patches.join(as_makers, "ref_key").drop("ref_key"))
        answers = _find(self.queries, self._replace(facts, 0), self.top)
        found = self.firsts.select("ref_key", "first_seq").join(answers, "ref_key", "left").withColumns(
            {"found_e": F.col("new_e"), "found_p": F.col("new_p"), "was": own})
        return self.targets.add(self._moved(found, own), 0).filter("moved")

    def _moved(self, found: DataFrame, own: Column) -> DataFrame:
        """Rows of the targets from `(ref_key, first_seq, found_e, found_p, was)`."""
        entity = F.coalesce("found_e", "found_p", own)
        return found.withColumn("entity", entity).withColumn("moved", F.col("entity") != F.col("was")).select("ref_key", *TARGET)

    def _facts_of(self, touched: DataFrame) -> DataFrame:
        """What is known of some customers by the targets of now."""
        targets = self.targets.all(touched)
        named = targets.join(touched, F.col("entity") == F.struct(*ENTITY), "left_semi").select("ref_key").distinct()
        now = self._latest(targets.join(named, "ref_key", "left_semi")).join(
            touched, F.col("entity") == F.struct(*ENTITY), "left_semi").select("ref_key", "entity.*", F.coalesce("found_e", "found_p").isNull().alias("_makes"))
        makers = now.filter("_makes").select("ref_key")
        return (
            self.known.join(touched, ENTITY, "left_semi")
            .unionByName(self.made.join(makers, "ref_key", "left_semi").drop("ref_key"))
            .unionByName(self.open_patches.join(now.drop("_makes"), "ref_key").drop("ref_key"))
        )

    def _next_round(self, number: int, moved: DataFrame) -> DataFrame:
        """The references whose target moved, from those that moved in the round before."""
        touched = self._touched(moved).distinct()
        before = self._held(self.intervals.all(touched).join(touched, ENTITY, "left_semi"), number - 1)
        now = self._replace(self._facts_of(touched), number)
        came_or_went = now.withColumn("_n", F.lit(1)).unionByName(before.withColumn("_n", F.lit(-1))).groupBy(*INTERVAL).agg(
            F.sum("_n").alias("_n")).filter("_n <> 0")
        keys = stored(came_or_went.select("key").distinct(), "keys")
        asked = self.queries.join(keys, "key", "left_semi")
        held = self._held(self.intervals.all(keys).join(keys, "key", "left_semi"), number)
        answers = _find(asked, held, self.top)
        old = self._latest(self.targets.all(keys).join(answers, "ref_key"), *answers.columns[1:])
        own = F.struct(F.lit(1).alias("is_new"), F.col("first_seq").alias("num"))
        found = old.withColumns({
            "was": F.col("entity"),
            **{f"found_{f}": F.when(F.col(f"asked_{f}"), F.col(f"new_{f}")).otherwise(F.col(f"found_{f}")) for f, _ in IDENTITY_KEYS},
        })
        return self.targets.add(self._moved(found, own), number).filter("moved")

    def run(self) -> tuple[DataFrame, int]:
        """For each new reference the customer found (null: it makes one), and the rounds needed."""
        number, moved = 0, self._first_round()
        while not moved.isEmpty():
            number += 1
            moved = self._next_round(number, moved)
        found = F.coalesce("found_e", "found_p")
        by = F.when(F.col("found_e").isNotNull(), "email").when(F.col("found_p").isNotNull(), "phone")
        return self._latest(self.targets.all(self.firsts)).select(
            "ref_key", "first_seq", found.alias("found"), by.alias("matched_by")), number + 1


# ---- documents -------------------------------------------------------------------------------

def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _variant(column: Column) -> Column:
    return column.cast("variant")


def _deal_texts(link: LinkFields) -> dict[str, Column]:
    return {
        "quoteValue": F.col("_f.quote_value"), "installationValue": F.col("_f.installation_value"),
        link.status: F.col("_f.ext_status"), link.modified: F.col("_f.modified"),
    }


def replay(
    events: DataFrame, jobs: DataFrame, customers: DataFrame, now: Column,
    link: LinkFields = LINK, bits: int = CHUNK_BITS,
) -> Replayed:
    """Apply `project_events` to the tables in the order of `seq` (whole, unique, not negative).

    Keys hold the tenant, and new records belong to the tenant of the event that makes them.

    Runs jobs of its own: the marked events and what each round works out are written to the shared
    folder.
    """
    return replay_on(events, whole_tables(jobs, customers, link), now, link, bits)


def replay_on(
    events: DataFrame, snapshot: Snapshot, now: Column, link: LinkFields = LINK, bits: int = CHUNK_BITS,
) -> Replayed:
    """`replay` on tables that are reached through a snapshot."""
    # The events are few against the tables or read many times over, so they are written once, and
    # the tables are cut down to the keys the events name before anything is shuffled.
    events = stored(events, "events")
    asked = events.select(F.explode(event_keys(events)).alias("key")).distinct()
    held = stored(snapshot.keys(asked), "held")
    # Where all rows of a fold fit a chunk, no key needs to be counted.
    n_rows = 3 * events.count() + held.count()
    few = n_rows <= 2**bits
    hot = NO_HOT_KEYS if few else None
    by_reference = F.col("key").startswith(REF_MARK)
    links = holders(held.filter(by_reference)).select(
        F.substring("key", len(REF_MARK) + 1, 2**31 - 1).alias("ref_key"),
        F.when(F.col("is_customer"), "customer").otherwise("job").alias("linked"),
        F.when(~F.col("is_customer"), F.col("id")).alias("linked_job"),
        F.col("owner").alias("linked_customer"), "stored",
    )

    # -- which events apply, and whom they patch
    keyed = events.filter(F.col("ref_key").isNotNull()).join(links, "ref_key", "left")
    folded = prefix_fold(keyed, ["ref_key"], "seq", {
        "_seen": ("max", blank_to_null(F.col("modified"))), "_before": ("sum", F.lit(1)),
    }, bits, hot)
    owners = links.select(F.col("linked_customer").alias("id")).filter("id is not null").distinct()
    present = snapshot.customers(owners).select(
        F.concat(F.lit("="), "id").alias("_k"), F.col("id").alias("_owner"),
        F.col("tenant_id").alias("_owner_tenant"),
    )
    # A job may name a customer of another tenant; that one is left alone.
    own = F.col("_owner_tenant").eqNullSafe(F.col("tenant_id"))
    marked = stored(
        folded.withColumn("is_first", F.col("_before") == 0)
        .withColumn("applied", ~is_stale(F.col("modified"), F.greatest("_seen", "stored")))
        .drop("_seen", "_before")
        .withColumn("_k", spread_null(F.col("linked_customer").cast("string"), F.col("seq")))
        .join(present, "_k", "left").withColumn("patched", F.when(own, F.col("_owner")))
        .drop("_k", "_owner", "_owner_tenant"), "marked",
    )
    last_seq = marked.agg(F.max("seq")).first()[0] or 0
    top = int(last_seq + 2).bit_length()

    # -- targets of new references
    firsts = (
        marked.filter(F.col("linked").isNull() & F.col("is_first"))
        .withColumnRenamed("seq", "first_seq")
    )
    targets, rounds = _Fixpoint(marked, firsts, held.filter(~by_reference), top, bits, few).run()
    targets = stored(targets, "targets")
    makers = ordinal(targets.filter(F.col("found").isNull()), "first_seq", "_n").select(
        "ref_key", "first_seq", (snapshot.last_customer + F.col("_n")).alias("made_customer")
    )
    found_jobs = ordinal(targets.filter(F.col("found").isNotNull()), "first_seq", "_n").withColumn(
        "made_job", snapshot.last_job + F.col("_n")
    ).join(
        makers.select(F.struct(F.lit(1).alias("is_new"), F.col("first_seq").alias("num"))
                      .alias("found"), F.col("made_customer").alias("_owner")), "found", "left",
    ).withColumn("owner", F.coalesce("_owner", "found.num"))
    resolved = makers.select(
        "ref_key", F.lit("customer").alias("new_kind"), F.lit(None).cast("long").alias("made_job"),
        F.col("made_customer").alias("owner"), F.lit(None).cast("string").alias("matched_by"),
    ).unionByName(found_jobs.select(
        "ref_key", F.lit("job").alias("new_kind"), "made_job", "owner", "matched_by"
    ))

    full = stored(marked.join(resolved, "ref_key", "left").withColumn(
        "target", F.coalesce("linked", "new_kind")
    ).withColumn("starts", F.col("linked").isNull() & F.col("is_first")).withColumn(
        "job", F.when(F.col("target") == "job", F.coalesce("linked_job", "made_job"))
    ).withColumn("customer", F.when(F.col("linked").isNull(), F.col("owner")).otherwise(
        F.col("patched")
    )), "full")

    return Replayed(
        actions=_actions(events, full),
        jobs=_job_rows(full, snapshot, now, link, bits, few),
        customers=_customer_rows(full, snapshot, now, link),
        rounds=rounds,
    )


def _actions(events: DataFrame, full: DataFrame) -> DataFrame:
    kind = F.col("target")
    action = (
        F.when(F.col("starts"), F.concat(F.lit("created-"), kind))
        .when(F.col("applied"), F.concat(F.lit("updated-"), kind))
        .otherwise("skipped-stale")
    )
    done = full.select(
        "seq", "reference", action.alias("action"), F.lit(None).cast("string").alias("reason"),
        F.col("job").alias("job_id"),
        F.when((kind == "customer") | F.col("starts"), F.coalesce("customer", "linked_customer"))
        .alias("customer_id"),
        F.when(F.col("starts"), F.col("matched_by")).otherwise("reference").alias("matched_by"),
    )
    none = F.lit(None).cast("long")
    skipped = events.filter(F.col("ref_key").isNull()).select(
        "seq", "reference", F.lit("skipped").alias("action"),
        F.lit("no reference on project").alias("reason"), none.alias("job_id"),
        none.alias("customer_id"), F.lit(None).cast("string").alias("matched_by"),
    )
    return done.unionByName(skipped)


def _titles(full: DataFrame, snapshot: Snapshot, bits: int, few: bool) -> DataFrame:
    """Name of the customer found by each new job's first event, as it was at that moment."""
    asked = full.filter(F.col("starts") & (F.col("target") == "job"))
    queries = asked.select("customer", (F.col("seq") * 2 + 1).alias("pos"), "ref_key",
                           F.lit(None).cast("string").alias("_name"))
    owners = asked.select("customer").distinct()
    no_ref = F.lit(None).cast("string").alias("ref_key")
    before = snapshot.customers(owners.withColumnRenamed("customer", "id")).select(
        F.col("id").alias("customer"), F.lit(0).cast("long").alias("pos"), no_ref,
        blank_to_null(F.col("name")).alias("_name"),
    )
    made = full.filter(F.col("starts") & (F.col("target") == "customer")).select(
        "customer", ((F.col("seq") + 1) * 2).alias("pos"), no_ref,
        first_nonempty(F.col("name"), F.col("reference")).alias("_name"),
    )
    patches = full.filter(F.col("applied") & ~F.col("starts") & F.col("customer").isNotNull()).select(
        "customer", ((F.col("seq") + 1) * 2).alias("pos"), no_ref,
        blank_to_null(F.col("name")).alias("_name"),
    )
    known = before.unionByName(made).unionByName(patches).filter(
        F.col("_name").isNotNull()
    ).join(owners, "customer", "left_semi")
    names = known.unionByName(queries)
    return prefix_fold(
        names if few else stored(names, "names"), ["customer"], "pos", {"owner_name": ("last", F.col("_name"))}, bits,
        NO_HOT_KEYS if few else None,
    ).filter(F.col("ref_key").isNotNull()).select("ref_key", "owner_name")


def _job_rows(
    full: DataFrame, snapshot: Snapshot, now: Column, link: LinkFields, bits: int, few: bool
) -> DataFrame:
    on_jobs = full.filter(F.col("target") == "job")
    deal = F.struct(*DEAL).alias("_f")

    changes = fold_sparse_updates(
        on_jobs.filter(F.col("linked").isNotNull() & F.col("applied")), "job", "seq", list(DEAL), is_stored=True
    ).select(F.col("job").alias("id"), deal)
    overlay = with_fields(parsed(F.col("data_json")), {
        "id": _variant(F.col("id")), "customerId": _variant(F.col("customer_id")),
        "title": _variant(F.col("title")), "status": _variant(F.col("status")),
        "createdAt": _variant(_iso(F.col("created_at"))),
    })
    changes = stored(changes, "job-changes")
    jobs = snapshot.jobs(changes.select("id"))
    updated = jobs.join(changes, "id").withColumn("_doc", overlay).withColumns({
        "data_json": F.to_json(with_nonempty_fields(F.col("_doc"), _deal_texts(link))),
        "status": first_nonempty(F.col("status"), F.lit(DEFAULT_STATUS)),
        "updated_at": now,
    }).select(*jobs.columns)

    fresh = on_jobs.filter(F.col("linked").isNull())
    folded = fold_sparse_updates(fresh, "ref_key", "seq", list(DEAL), is_stored=True).select("ref_key", deal)
    born = fresh.filter(F.col("starts")).select(
        "ref_key", "tenant_id", "job", "customer", "name", "reference"
    )
    title = first_nonempty(F.col("owner_name"), F.col("name"), F.col("reference"))
    text = {k: F.coalesce(v, F.lit("")) for k, v in _deal_texts(link).items()}
    doc = F.to_variant_object(F.create_map(*[c for k, v in {
        "customerId": _variant(F.col("customer")), "title": _variant(title),
        "status": _variant(F.lit(DEFAULT_STATUS)), "reference": _variant(F.col("reference")),
        link.ref: _variant(F.col("reference")),
        **{k: _variant(v) for k, v in text.items()},
        "wonAt": _variant(_iso(now)), "tabs": F.parse_json(F.lit(EMPTY_TABS)),
    }.items() for c in (F.lit(k), v)]))
    inserted = (
        born.join(folded, "ref_key").join(_titles(full, snapshot, bits, few), "ref_key", "left")
        .select(
            F.col("job").alias("id"), "tenant_id",
            F.col("customer").alias("customer_id"), title.alias("title"),
            F.lit(DEFAULT_STATUS).alias("status"), F.to_json(doc).alias("data_json"),
            now.alias("created_at"), now.alias("updated_at"),
        )
    )
    return updated.unionByName(inserted.select(*jobs.columns))


def _customer_rows(
    full: DataFrame, snapshot: Snapshot, now: Column, link: LinkFields
) -> DataFrame:
    # Who a person is comes from every applied event but the one that opened a job.
    about_person = full.filter(
        F.col("customer").isNotNull() & F.col("applied")
        & ~(F.col("starts") & (F.col("target") == "job"))
    )
    identity = fold_sparse_updates(about_person, "customer", "seq", list(IDENTITY), is_stored=True)
    on_customers = full.filter((F.col("target") == "customer") & F.col("applied"))
    deals = fold_sparse_updates(on_customers, "customer", "seq", list(DEAL), is_stored=True)
    changes = identity.join(deals, "customer", "left").select(
        F.col("customer").alias("id"), F.struct(*IDENTITY, *DEAL).alias("_f")
    )

    overlay = with_fields(parsed(F.col("data_json")), {
        "id": _variant(F.col("id")), "name": _variant(F.col("name")),
        "stage": _variant(F.col("stage")), "createdAt": _variant(_iso(F.col("created_at"))),
    })
    texts = {**{f: F.col(f"_f.{f}") for f in IDENTITY}, **_deal_texts(link)}
    changes = stored(changes, "customer-changes")
    customers = snapshot.customers(changes.select("id"))
    updated = customers.join(changes, "id").withColumn("_doc", overlay).withColumns({
        "data_json": F.to_json(with_nonempty_fields(F.col("_doc"), texts)),
        "name": F.coalesce(blank_to_null(F.col("_f.name")), F.col("name")),
        "stage": first_nonempty(F.col("stage"), F.lit(DEFAULT_STAGE)),
        "updated_at": now,
    }).select(*customers.columns)

    born = full.filter(F.col("starts") & (F.col("target") == "customer")).select(
        F.col("customer").alias("id"), "tenant_id", "reference",
        derive_stage(F.col("quote_value")).alias("stage"),
    )
    name = first_nonempty(F.col("_f.name"), F.col("reference"))
    doc = F.to_variant_object(F.create_map(*[c for k, v in {
        "name": _variant(name),
        **{f: _variant(F.coalesce(F.col(f"_f.{f}"), F.lit(""))) for f in IDENTITY[1:]},
        "source": _variant(F.lit(link.source)), "stage": _variant(F.col("stage")),
        link.ref: _variant(F.col("reference")),
        **{k: _variant(F.coalesce(v, F.lit(""))) for k, v in _deal_texts(link).items()},
        "tabs": F.parse_json(F.lit(EMPTY_TABS)),
    }.items() for c in (F.lit(k), v)]))
    inserted = born.join(changes, "id").select(
        "id", "tenant_id", name.alias("name"), "stage",
        F.to_json(doc).alias("data_json"), now.alias("created_at"), now.alias("updated_at"),
    )
    return updated.unionByName(inserted.select(*customers.columns))


def merged(snapshot: DataFrame, changed: DataFrame) -> DataFrame:
    """The snapshot with changed rows exchanged and new ones added."""
    return snapshot.join(changed.select("id"), "id", "left_anti").unionByName(changed)

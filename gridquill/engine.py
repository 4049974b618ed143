"""The knowledge base as a whole: folders, uploads, listings, deletes, search, chat context.

Tables are Parquet under one root, in folders that are written once. A numbered manifest lists the folders
of every table, each with the number of the commit that added it; readers take the manifest of the highest number. Deletes and
updates rewrite nothing: they add *tombstones*, folders of keys, and a reader leaves out the rows whose key has a
tombstone of a later commit. ``compact`` folds the folders and tombstones of a table into files of a useful size.

A change is built on the newest manifest and published under the next number, which one writer alone can claim. A
writer that comes second looks at what was published meanwhile: if it touches a table the change was computed from, the
change is computed again; if not, it is added to the newer manifest. So the outcome is that of some serial order. Documents,
sheets and chunks get ids from natural keys (hashes of path, sheet and order); a document that is uploaded
again is replaced in one commit. A stream's last batch is part of the manifest, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import catalog, classify, enrich, grams, parsers, search
from .operators.cells import dump_text
from .schemas import schema
from .sources import xlsx
from .storage import stored
from .streaming import progress

FINAL, RECALL = search.FINAL, search.RECALL


def _key(*cols: str) -> Column:
    return F.abs(F.xxhash64(*cols))


#: Column that tombstones of a table name, where it isn't the id.
KEY = {"chunk_vec": "chunk_id", "summary_vec": "summary_id", "postings": "ref_id", "grams": "ref_id", "enrich_attempt": "chunk_id"}
CASCADED = ("folder", "document", "sheet", "chunk", "chunk_summary", "image", "change_log", "data_dict")
#: Where the manifest of an empty knowledge base starts.
EMPTY: dict = {"data": {}, "gone": {}, "streams": {}}


@dataclass
class Change:
    """What a commit does: rows that come, keys (a column key, and kind for postings) that go, the batch of a stream."""

    rows: dict[str, DataFrame] = field(default_factory=dict)
    gone: dict[str, DataFrame] = field(default_factory=dict)
    stream: tuple[str, int] | None = None


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column] = enrich.embed, scorer: Callable[[Column, Column], Column] = search.term_overlap):
        self.spark, self.root, self.embed, self.scorer = spark, root.rstrip("/"), embed, scorer
        self._built: tuple[str, search.Index] | None = None

    # storage ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _current(self) -> tuple[int, dict]:
        numbers = self._manifests()
        if not numbers:
            return 0, EMPTY
        rows = self.spark.read.text(f"{self.root}/manifest/{numbers[-1]:09d}.json").collect()
        return numbers[-1], json.loads("".join(r[0] for r in rows))

    def _numbered(self, folders: list[list], ddl) -> DataFrame:
        """Rows of some folders with the commit that added them (__at)."""
        at = self.spark.createDataFrame([(p.rsplit("/", 1)[1], n) for p, n in folders], "__folder string, __at long")
        rows = self.spark.read.schema(ddl).parquet(*(f"{self.root}/{p}" for p, _ in folders))
        rows = rows.select("*", F.regexp_extract("_metadata.file_path", "/([0-9a-f]{32})/[^/]*$", 1).alias("__folder"))
        return rows.join(F.broadcast(at), "__folder").drop("__folder")  # a row per folder; compact keeps them few

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        """A table as of a manifest, the newest by default."""
        state = state or self._current()[1]
        folders = state["data"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema(name))
        oldest = min(n for _, n in folders)
        gone = [x for x in state["gone"].get(name, []) if x[1] > oldest]
        if not gone:
            return self.spark.read.schema(schema(name)).parquet(*(f"{self.root}/{p}" for p, _ in folders))
        marks = self._numbered(gone, "key long, kind string").groupBy("key", "kind").agg(F.max("__at").alias("__gone"))
        rows = self._numbered(folders, schema(name))
        hit = (rows[KEY.get(name, "id")] == marks["key"]) & (marks["__gone"] > rows["__at"])
        if name == "postings":
            hit &= rows["kind"] == marks["kind"]
        return rows.join(marks, hit, "left_anti").select(*schema(name).names)

    def _write(self, name: str, df: DataFrame) -> str:
        at = f"{name}/{uuid.uuid4().hex}"
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)]
        df.select(*cast).write.parquet(f"{self.root}/{at}")
        return at

    def _write_gone(self, name: str, keys: DataFrame) -> str:
        at = f"gone-{name}/{uuid.uuid4().hex}"
        kind = F.col("kind") if "kind" in keys.columns else F.lit(None)
        keys.select(F.col("key").cast("long").alias("key"), kind.cast("string").alias("kind")).write.parquet(f"{self.root}/{at}")
        return at

    def _claim(self, number: int, patience: float = 30.0) -> bool:
        """Whether this writer owns manifest ``number``; False: another has published it meanwhile. The lock of a
        writer that died is not removed but outbid: the holder of the highest lock of a number owns it."""
        fs, folder = self._fs(f"{self.root}/manifest")
        bid, until = 0, time.monotonic() + patience
        while number not in self._manifests():
            if fs.createNewFile(self._fs(f"{self.root}/manifest/{number:09d}.lock{bid:04d}")[1]):
                self._bid = bid
                return True
            held = [int(n[-4:]) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if n.startswith(f"{number:09d}.lock")]
            if max(held, default=0) > bid:  # someone else has outbid it
                bid, until = max(held), time.monotonic() + patience
            elif time.monotonic() > until:
                bid, until = bid + 1, time.monotonic() + patience
            time.sleep(0.05)
        return False

    def _outbid(self, number: int) -> bool:
        fs, path = self._fs(f"{self.root}/manifest/{number:09d}.lock{self._bid + 1:04d}")
        return fs.exists(path)

    def _publish(self, number: int, state: dict) -> bool:
        """Whether ``state`` has become manifest ``number``."""
        if not self._claim(number) or self._manifests()[-1:] not in ([], [number - 1]):
            return False
        fs, temp = self._fs(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._fs(f"{self.root}/manifest/{number:09d}.json")[1]
        return not self._outbid(number) and not fs.exists(final) and fs.rename(temp, final)

    def transact(self, build: Callable[[dict], Change | None], reads: tuple[str, ...] = ()) -> bool:
        """Publish the change that ``build`` makes of the newest manifest (None: nothing to do). ``reads``: the tables it
        is computed from; if another writer's commit touches one of them first, it is built again."""
        base, state = self._current()
        while (change := build(state)) is not None:
            rows = {name: self._write(name, df) for name, df in change.rows.items()}
            gone = {name: self._write_gone(name, df) for name, df in change.gone.items()}
            fresh = True
            while fresh:
                add = lambda old, new, n: old | {k: [*old.get(k, []), [at, n]] for k, at in new.items()}
                streams = state["streams"] | (dict([change.stream]) if change.stream else {})
                if self._publish(base + 1, {"data": add(state["data"], rows, base + 1), "gone": add(state["gone"], gone, base + 1), "streams": streams}):
                    return True
                before = state
                base, state = self._current()
                same = lambda part, k: before[part].get(k) == state[part].get(k)  # noqa: E731, B023
                fresh = all(same("data", k) and same("gone", k) for k in reads) and not (change.stream and not same("streams", change.stream[0]))
        return False

    def append(self, **tables: DataFrame) -> None:
        self.transact(lambda _: Change(rows=tables))

    def compact(self, name: str, files: int = 1) -> None:
        """Fold the folders and tombstones of a table into one folder of ``files`` files. What others append or
        delete meanwhile stays as it is: the fold counts as old as its youngest part."""
        base, state = self._current()
        seen, marks = state["data"].get(name, []), state["gone"].get(name, [])
        if not seen:
            return
        folded = [self._write(name, self.table(name, state).repartition(files)), base]
        while True:
            now, newer = self._current()
            if any(x not in newer["data"].get(name, []) for x in seen):
                return  # another compaction was first
            data = newer["data"] | {name: [folded, *(x for x in newer["data"][name] if x not in seen)]}
            gone = newer["gone"] | {name: [x for x in newer["gone"].get(name, []) if x not in marks]}
            if self._publish(now + 1, newer | {"data": data, "gone": gone}):
                return

    # folders and documents -------------------------------------------------------------------

    def create_folder(self, name: str, color: str = "amber") -> int:
        if not name or not name.strip():
            raise ValueError("a folder needs a name")
        made = []

        def build(state: dict) -> Change:
            made.append((self.table("folder", state).agg(F.max("id")).first()[0] or 0) + 1)
            return Change(rows={"folder": self.spark.range(1).select(F.lit(made[-1]).alias("id"), F.lit(name).alias("name"), F.lit(color).alias("color"), F.current_timestamp().alias("created_at"))})

        self.transact(build, ("folder",))
        return made[-1]

    def update_folder(self, folder_id: int, name: str | None = None, color: str | None = None) -> None:
        new = {k: F.lit(v) for k, v in (("name", name), ("color", color)) if v}
        self._update("folder", F.col("id") == folder_id, new)

    def update_document(self, document_id: int, **values: object) -> None:
        """Sets columns of a document, such as status, enrich_status, error_msg or doc_metadata."""
        self._update("document", F.col("id") == document_id, {k: F.lit(v) for k, v in values.items()})

    def _update(self, name: str, which: Column, values: dict[str, Column]) -> None:
        def build(state: dict) -> Change | None:
            rows = stored(self.table(name, state).where(which).withColumns(values), "updated")
            return None if rows.isEmpty() else Change({name: rows}, {name: rows.select(F.col(KEY.get(name, "id")).alias("key"))})

        if values:
            self.transact(build, (name,))

    def list_folders(self) -> DataFrame:
        return catalog.folder_listing(self.table("folder"), self.table("document"), self.table("chunk")).orderBy(F.desc("created_at"), "id")

    def list_documents(self, folder_id: int | None = None) -> DataFrame:
        return catalog.document_listing(self.table("document"), self.table("chunk"), folder_id).orderBy(F.desc("uploaded_at"), "id")

    def list_chunks(self, document_id: int) -> DataFrame:
        sheets = self.table("sheet").select(F.col("id").alias("sheet_id"), "name")
        return catalog.chunk_listing(self.table("chunk"), sheets, document_id).orderBy("sheet_id", "chunk_order")

    def chunk(self, chunk_id: int) -> DataFrame:
        own = self.table("chunk").where(F.col("id") == chunk_id).withColumnRenamed("id", "chunk_id")
        return catalog.nested(own, self.table("chunk_summary").select("chunk_id", "perspective", F.col("text").alias("summary")), "chunk_id", ["perspective", "summary"], "summaries")

    def _lost(self, table: str, ids: DataFrame, state: dict) -> dict[str, DataFrame]:
        """Tombstones of some rows and of all that hangs on them."""
        keys = catalog.cascade_keys({n: self.table(n, state) for n in CASCADED}, table, ids)
        of = lambda name, kind: keys.pop(name).withColumn("kind", F.lit(kind))
        keys["grams"] = keys["postings_chunk"]
        keys["enrich_attempt"] = keys["postings_chunk"]
        keys["postings"] = of("postings_chunk", "chunk").unionByName(of("postings_summary", "summary"))
        return {name: df for name, df in keys.items() if name in state["data"]}

    def _delete(self, table: str, ids: list[int]) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id long")
        self.transact(lambda state: Change(gone=self._lost(table, gone, state)), CASCADED)

    def delete_folder(self, folder_id: int) -> None:
        self._delete("folder", [folder_id])

    def delete_document(self, document_id: int) -> None:
        self._delete("document", [document_id])

    # ingestion -------------------------------------------------------------------------------

    def upload(self, files: DataFrame, folder_id: int, vision: DataFrame | None = None, max_cells: int = 20_000, stream: tuple[str, int] | None = None) -> bool:
        """files: (path, content). Parses every workbook once, classifies, indexes, embeds, then publishes one
        commit. A path that was uploaded before replaces its document. ``stream``: name and batch; a batch that is on record
        is not uploaded again. Whether anything was published; a folder that is gone is an error."""
        if stream and self._current()[1]["streams"].get(stream[0], -1) >= stream[1]:
            return False
        book = {k: stored(v, f"book-{k}") for k, v in xlsx.from_files(files, max_cells).items()}
        sid = _key("document_id", "sheet_index")
        sheets = book["sheets"].withColumn("sheet_id", sid)
        cells = book["cells"].withColumn("sheet_id", sid)
        images = book["images"].withColumn("sheet_id", sid).withColumn("description", F.lit(None).cast("string"))
        kinds = stored(classify.classify(sheets.select("sheet_id", "name", "has_images"), cells), "kinds")
        context = parsers.document_context(sheets, cells, kinds, vision)
        meta = context[2]
        place = sheets.select("sheet_id", "document_id", "sheet_index")
        chunks = parsers.dispatch(sheets, cells, kinds, images, vision, context).join(place, "sheet_id")
        chunks = chunks.select(_key("sheet_id", "kind", "chunk_order").alias("id"), "sheet_id", "document_id", F.lit(folder_id).alias("folder_id"), "text", "markdown", F.to_json(F.struct("kind", "jira_tags", "enrich_eligible")).alias("chunk_metadata"), "hierarchy_path", "chunk_order", F.current_timestamp().alias("created_at"))
        chunks = stored(chunks, "chunks")
        history = parsers.history_entries(cells.join(kinds.where("sheet_type = 'history'"), "sheet_id", "left_semi")).join(place, "sheet_id")
        words = parsers.data_dictionary(cells.join(kinds.where("sheet_type in ('table', 'index')"), "sheet_id", "left_semi")).join(place, "sheet_id")
        document_id = F.xxhash64("path")
        documents = files.select(document_id.alias("id"), F.lit(folder_id).alias("folder_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("file_path"), F.octet_length("content").cast("long").alias("file_size"), F.current_timestamp().alias("uploaded_at"))
        failed = book["errors"].where("sheet_index is null").groupBy(F.col("document_id").alias("id")).agg(F.min("message").alias("error_msg"))
        notes = book["errors"].where("sheet_index is not null").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", F.col("sheet_index").cast("string"), "message"))), "; ").alias("notes"))
        documents = documents.join(failed, "id", "left").join(notes, "id", "left").join(meta.select(F.col("document_id").alias("id"), F.to_json(F.struct("title", "module", "customer", "vendor", "version", "jira_codes")).alias("doc_metadata")), "id", "left")
        documents = documents.withColumns({"status": F.when(F.col("error_msg").isNull(), "ready").otherwise("failed"), "enrich_status": F.lit("pending"), "indexed_at": F.when(F.col("error_msg").isNull(), F.current_timestamp())})
        documents = documents.withColumn("error_msg", F.coalesce("error_msg", "notes"))  # sheets that failed leave a note
        texts = dump_text(cells).select("sheet_id", "raw_text")
        rows = sheets.join(kinds, "sheet_id").join(texts, "sheet_id", "left").select(F.col("sheet_id").alias("id"), "document_id", "name", "sheet_index", "sheet_type", F.col("confidence").alias("classifier_confidence"), "raw_text")
        pictures = images.select(_key("sheet_id", "image_index").alias("id"), "sheet_id", F.concat(X.image_digest(F.col("bytes")), F.lit("."), X.image_format(F.col("format"))).alias("file_path"), "anchor_cell")
        blobs = catalog.distinct_images(images).join(self.table("image_blob").select("digest"), "digest", "left_anti")
        new = dict(
            document=documents,
            sheet=rows,
            image_blob=blobs,
            chunk=chunks,
            image=pictures,
            change_log=history.select(_key("sheet_id", "chunk_order").alias("id"), "document_id", "log_date", "description", "tags"),
            data_dict=words.withColumn("id", _key("sheet_id", "row")),
            chunk_vec=chunks.select(F.col("id").alias("chunk_id"), self.embed(F.col("text")).alias("embedding")),
            postings=search.postings(chunks, "id", "text"),
            grams=grams.gram_postings(chunks),
        )
        new = {name: stored(df, f"new-{name}") for name, df in new.items()}
        return self.transact(lambda state: self._placed(state, new, folder_id, stream), CASCADED)

    def _placed(self, state: dict, new: dict[str, DataFrame], folder_id: int, stream: tuple[str, int] | None) -> Change | None:
        if stream and state["streams"].get(stream[0], -1) >= stream[1]:
            return None
        if self.table("folder", state).where(F.col("id") == folder_id).isEmpty():
            raise ValueError(f"there is no folder {folder_id}")
        again = stored(self.table("document", state).join(new["document"].select("id"), "id", "left_semi").select("id"), "again")
        return Change(new, {} if again.isEmpty() else self._lost("document", again, state), stream)

    def ingest(self, landing: str, checkpoint: str, folder_id: int, name: str):
        """Uploads what lands in a folder, a micro-batch a commit, each once: the batch is part of the commit."""
        return progress.ingest_stream(self.spark, landing, checkpoint, lambda df, batch: self.upload(df.select("path", "content"), folder_id, stream=(name, batch)))

    def enrich(self, model: Callable[[str], str], in_flight: int = enrich.IN_FLIGHT) -> None:
        """Background job: summaries of the eligible chunks not asked for yet, their vectors and postings."""
        opted = F.coalesce(F.get_json_object("chunk_metadata", "$.enrich_eligible") != "false", F.lit(True))
        gate = enrich.enrich_gate(self.table("chunk").withColumn("enrich_eligible", opted))
        todo = stored(enrich.pending(gate, self.table("chunk_summary"), self.table("enrich_attempt")), "enrich")
        long = catalog.summaries_long(enrich.enrich(todo, model, in_flight).withColumnRenamed("id", "chunk_id")).withColumn("id", _key("chunk_id", "perspective"))
        long = stored(long, "summaries")

        def build(state: dict) -> Change:
            # of chunks that are still there; an attempt is on record even if the answer was empty: it is not asked again
            here = self.table("chunk", state).select(F.col("id").alias("chunk_id"))
            tried = todo.select(F.col("id").alias("chunk_id"), F.current_timestamp().alias("attempted_at")).join(here, "chunk_id", "left_semi")
            new = stored(long.join(here, "chunk_id", "left_semi").join(self.table("chunk_summary", state).select("id"), "id", "left_anti"), "new-summaries")
            done = stored(self.table("document", state).where("status = 'ready' and enrich_status is distinct from 'done'").withColumn("enrich_status", F.lit("done")), "enriched")
            rows = dict(chunk_summary=new, enrich_attempt=tried, document=done, summary_vec=new.select(F.col("id").alias("summary_id"), self.embed(F.col("text")).alias("embedding")), postings=search.postings(new, "id", "text", "summary"))
            return Change(rows, {"document": done.select(F.col("id").alias("key"))})

        self.transact(build, ("document", "chunk", "chunk_summary"))

    # questions -------------------------------------------------------------------------------

    def search(self, questions: DataFrame, limit: int = FINAL, recall: int = RECALL) -> DataFrame:
        """questions: query_id, question and, if scoped, folder_id and document_id."""
        # stored, so that the recall paths share one embedding of each question
        q = stored(questions.withColumn("embedding", self.embed(F.col("question"))), "questions")
        for c in ("folder_id", "document_id"):
            if c not in q.columns:
                q = q.withColumn(c, F.lit(None).cast("long"))
        sheets = self.table("sheet").select(F.col("id").alias("sheet_id"), "name", "sheet_type")
        summaries = self.table("chunk_summary").join(self.table("summary_vec").withColumnRenamed("summary_id", "id"), "id").select("id", "chunk_id", "embedding")
        state = self._current()[1]
        chunks, index, kept = self.table("chunk", state), self._index(state), self.table("grams", state)
        # chunks that were appended without their grams get them here
        fresh = chunks.join(kept.select(F.col("ref_id").alias("id")).distinct(), "id", "left_anti")
        kept = kept.unionByName(grams.gram_postings(fresh))
        return search.hybrid_search(q, chunks, sheets, self.table("document", state), index, self.table("chunk_vec", state), summaries, limit, recall, self.scorer, kept, isolate=True)

    def _index(self, state: dict) -> search.Index:
        """The lexical index of the postings, built again when a commit has changed them."""
        version = json.dumps([state["data"].get("postings"), state["gone"].get("postings")])
        if self._built is None or self._built[0] != version:
            self._built = (version, search.build_index(self.table("postings", state)))
        return self._built[1]

    def answer_context(self, questions: DataFrame, limit: int = FINAL) -> DataFrame:
        """query_id, context, citations: what a language model is given."""
        return search.context(self.search(questions, limit), questions)

    def record_message(self, session_id: str, role: str, content: str, context_mode: str = "all", citations: str = "[]") -> None:
        row = self.spark.range(1).select(F.lit(uuid.uuid4().int % 2**62).cast("long").alias("id"), F.lit(session_id).alias("session_id"), F.lit(role).alias("role"), X.answer_body(F.lit(content)).alias("content"), F.lit(context_mode).alias("context_mode"), F.lit(citations).alias("citations"), X.confidence(F.lit(content)).alias("confidence"), F.current_timestamp().alias("created_at"))
        self.append(chat_message=row)

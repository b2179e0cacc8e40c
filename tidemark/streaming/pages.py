"""A feed that gives its newest items page by page, as a stream source with offsets of its own.

Pages are folders page=N of Parquet files, landed in order.  The offset is the last page taken and
the high-water mark: the largest id seen up to it.  The mark never moves back, items at or below
it are not given out again, and a restart goes on from the offset in the checkpoint.  A page that
holds as many items as fit may have been cut, and says so on its items; `recovered` reads such days again.

Marks come from the statistics in the files' footers, one page after the other, and are remembered while
the query runs; items are read in the tasks, a page each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.scratch import file_system

FIELDS = ("page", "mark", "may_be_cut")


@dataclass
class Page(InputPartition):
    folder: str
    number: int
    mark: int | None
    items: int


class PageReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields if f.name not in FIELDS]
        self.folder, self.id, self.limit = options["path"], options["id"], int(options["limit"])
        self.tops: dict[int, tuple[int | None, int]] = {}

    def _pages(self, after: int) -> list[int]:
        from pyarrow import fs

        system, path = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(n for f in found if f.base_name.startswith("page=") and (n := int(f.base_name[5:])) > after)

    def _files(self, page: int):
        from pyarrow import fs

        system, path = file_system(self.folder)
        return system, [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/page={page}")) if f.base_name.endswith(".parquet")]

    def _top(self, page: int) -> tuple[int | None, int]:
        """Largest id of a page, and how many items it has, by the footers."""
        if page not in self.tops:
            import pyarrow.parquet as pq

            system, files = self._files(page)
            most, count = None, 0
            for file in files:
                with system.open_input_file(file) as f:
                    meta = pq.ParquetFile(f).metadata
                column = meta.schema.names.index(self.id)
                groups = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
                most = max([x for x in [most, *(g.max for g in groups if g and g.has_min_max)] if x is not None], default=None)
                count += meta.num_rows
            self.tops[page] = most, count
        return self.tops[page]

    def initialOffset(self) -> dict:
        return {"page": -1, "mark": ""}

    def latestOffset(self) -> dict:
        pages, mark = self._pages(-1), None
        for page in pages:
            mark = max([x for x in (mark, self._top(page)[0]) if x is not None], default=None)
        return {"page": pages[-1] if pages else -1, "mark": "" if mark is None else str(mark)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        mark, out = int(start["mark"]) if start["mark"] else None, []
        for page in self._pages(start["page"]):
            if page > end["page"]:
                break
            top, items = self._top(page)
            out.append(Page(self.folder, page, mark, items))
            mark = max([x for x in (mark, top) if x is not None], default=None)
        return out

    def read(self, partition: Page):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, files = self._files(partition.number)
        for file in files:
            with system.open_input_file(file) as f:
                rows = pq.read_table(f, columns=self.names)
            if partition.mark is not None:
                rows = rows.filter(pc.greater(rows.column(self.id), partition.mark))
            n = rows.num_rows
            more = {"page": pa.array([partition.number] * n, pa.int64()), "mark": pa.array([partition.mark] * n, pa.int64()), "may_be_cut": pa.array([partition.items >= self.limit] * n, pa.bool_())}
            for name, column in more.items():
                rows = rows.append_column(name, column)
            yield from rows.to_batches()


class IndexPages(DataSource):
    """Format index_pages: options path, id (a long column) and limit (items that fit on a page)."""

    @classmethod
    def name(cls) -> str:
        return "index_pages"

    def streamReader(self, schema) -> PageReader:
        return PageReader(schema, self.options)


def land(items: DataFrame, page: str, folder: str) -> None:
    """Put pages (rows with a page number) into the folder; a page is one task's and bounded by what fits on it."""
    items.repartition(F.col(page)).withColumnRenamed(page, "page").write.partitionBy("page").mode("append").parquet(folder)


def stream(spark: SparkSession, folder: str, items: str, id: str, limit: int) -> DataFrame:
    """New items of the pages in a folder, with page, mark (before that page) and may_be_cut; items: their schema."""
    spark.dataSource.register(IndexPages)
    schema = f"{items}, page long, mark long, may_be_cut boolean"
    return spark.readStream.format("index_pages").schema(schema).option("id", id).option("limit", limit).load(folder)


def recovered(seen: DataFrame, all_items: DataFrame, day: str, id: str) -> DataFrame:
    """Items of the days whose page may have been cut that no page has brought."""
    cut = seen.where("may_be_cut").select(day).distinct()
    return all_items.join(cut, day, "left_semi").join(seen.select(id), id, "left_anti")

"""Selection, projection and ordering (OP-10..18, OP-45, OP-46)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import STATUS_CLASS, STATUS_CLASS_ACTIVE, STATUS_IN_PROCESS, STATUS_PRINTED


def _printed_prefilter(status: str) -> Column:
    """A weaker, pushable predicate implied by "not printed".

    ``upper(coalesce(s,'')) <> 'PRINTED'`` cannot reach the Parquet reader,
    but it implies ``s IS NULL OR s <> 'PRINTED'``, which can: row groups that
    hold only the canonical written value ``PRINTED`` are skipped at the scan.
    """
    return F.col(status).isNull() | (F.col(status) != F.lit(STATUS_PRINTED))


def active_sheet(df: DataFrame, status: str = "STATUS") -> DataFrame:
    """OP-10: rows whose stripped, upper-cased status is not PRINTED (NULL is active)."""
    return df.filter(_printed_prefilter(status) & (tx.status_norm_sheet(status) != F.lit(STATUS_PRINTED)))


def status_class(status: str = "status") -> Column:
    """PRINTED / ACTIVE class of a row (table mode), stored as a partition column."""
    return F.when(tx.status_norm_table(status) == F.lit(STATUS_PRINTED), F.lit(STATUS_PRINTED)) \
            .otherwise(F.lit(STATUS_CLASS_ACTIVE))


def active_table(df: DataFrame, status: str = "status") -> DataFrame:
    """OP-11: rows whose upper-cased status is not PRINTED; blanks are not stripped.

    On a table stored with the ``status_class`` partition column (written
    from the same rule), the equivalent partition filter prunes the printed
    history at planning time: only the ACTIVE folders are listed and read.
    """
    cond = _printed_prefilter(status) & (tx.status_norm_table(status) != F.lit(STATUS_PRINTED))
    if STATUS_CLASS in df.columns:
        cond = (F.col(STATUS_CLASS) == F.lit(STATUS_CLASS_ACTIVE)) & cond
    return df.filter(cond)


def active_exact(df: DataFrame, status: str = "status") -> DataFrame:
    """OP-12: the documented strict variant, status = IN PROCESS (any case)."""
    return df.filter(F.upper(F.col(status)) == F.lit(STATUS_IN_PROCESS))


def joined_columns() -> list[Column]:
    """The 14 columns the registry query selects (OP-13 first half, OP-02).

    Works on the star joined with USING keys, so every name is unique.
    """
    return [
        F.col("file_number"),
        F.col("serial"),
        F.upper("name").alias("name"),
        F.upper("sex").alias("sex"),
        F.col("birth_date"),
        F.upper(tx.concat_null_empty("place", F.rtrim(F.col("state_code")), sep=", ")).alias("place_of_birth"),
        F.upper("name_of_father").alias("name_of_father"),
        F.upper("name_of_mother").alias("name_of_mother"),
        F.upper(tx.concat_null_empty("address_line_1", "address_line_2", "address_line_3",
                                     sep=", ")).alias("address"),
        F.col("registration_date"),
        F.col("mha_file_number"),
        F.col("mha_date"),
        F.upper("ib_staff_authority_name").alias("signing_authority_name"),
        F.upper(tx.concat_null_empty("ib_staff_authority_name", "ib_staff_authority_designation",
                                     sep=", ")).alias("authority_name_designation"),
    ]


def project_record(joined: DataFrame, year: int) -> DataFrame:
    """OP-13: shape the 14 selected columns into the fixed 12-field record.

    Adds ``year`` (D4: both the column and the ``n/year`` serial) and the
    numeric ``serial_no`` that orders the records.
    """
    return joined.select(
        F.col("file_number").alias("File_Number"),
        tx.serial_with_year("serial", year).alias("Serial"),
        F.col("name").alias("Name"),
        F.col("sex").alias("Sex"),
        tx.date_and_text("birth_date", "place_of_birth").alias("When_and_where_born"),
        F.col("name_of_father").alias("Name_of_the_Father"),
        F.col("name_of_mother").alias("Name_of_the_Mother"),
        F.col("address").alias("Description_and_residence_of_informant"),
        tx.format_date("registration_date").alias("Registration_date"),
        tx.text_and_date("mha_file_number", "mha_date").alias("MHA_File_And_date"),
        F.col("signing_authority_name").alias("Signing_Authority_Name"),
        F.col("authority_name_designation").alias("Signing_Authority_Name_Designation"),
        F.lit(int(year)).alias("year"),
        F.col("serial").alias("serial_no"),
    )


LISTING_COLUMNS = (
    "serial", "name", "sex", "birth_date", "place_of_birth", "name_of_father",
    "name_of_mother", "address", "registration_date", "mha_file_number", "mha_date",
    "signing_authority_name", "authority_name_designation",
)


def project_listing(joined: DataFrame) -> DataFrame:
    """OP-14: the 13-column listing (no file number), ordered by serial."""
    return joined.select(*LISTING_COLUMNS).orderBy("serial")


def project_pairs(df: DataFrame, key: str = "MHA_FILE_NUMBER", value: str = "MHA_DATE") -> DataFrame:
    """OP-17: narrow to (parent key, parent date)."""
    return df.select(key, value)


def inject_year(df: DataFrame, year: int, col: str = "year") -> DataFrame:
    """OP-18: add the run year as a column (a parameter, so results repeat)."""
    return df.withColumn(col, F.lit(int(year)))


def order_by_serial(df: DataFrame, serial: str = "serial", *tiebreak: str) -> DataFrame:
    """OP-45: ascending integer serial (distributed range sort)."""
    return df.orderBy(F.col(serial).asc_nulls_first(), *[F.col(t) for t in tiebreak])


SERIAL_HELPER = "__serial_num__"


def add_serial_helper(df: DataFrame, serial: str = "Serial") -> DataFrame:
    """OP-16 (add): numeric sort key from a text serial."""
    return df.withColumn(SERIAL_HELPER, tx.first_digits(serial))


def drop_serial_helper(df: DataFrame) -> DataFrame:
    """OP-16 (drop)."""
    return df.drop(SERIAL_HELPER)


def order_by_serial_text(df: DataFrame, serial: str = "Serial", tiebreak: Sequence[str] = ("File_Number",)) -> DataFrame:
    """OP-46: ascending by the first digit run of a text serial (0 when none).

    Ties are broken by ``tiebreak`` so the order is deterministic.
    """
    out = add_serial_helper(df, serial).orderBy(SERIAL_HELPER, *tiebreak)
    return drop_serial_helper(out)

"""Preparation of two clinical databases into transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.functions import text
from tallyrift.operators import dictionary
from tallyrift.operators.profile import earliest_records
from tallyrift.session import materialize

# Admission source -> admission type, and admission type -> id.
ADMISSION_TYPE_OF_SOURCE = {
    "Direct Admit": "URGENT",
    "Emergency Department": "EW EMER.",
    "Floor": "OBSERVATION ADMIT",
    "Operating Room": "SURGICAL SAME DAY ADMISSION",
    "Other Hospital": "URGENT",
    "Other ICU": "URGENT",
    "ICU to SDU": "OBSERVATION ADMIT",
    "Step-Down Unit (SDU)": "OBSERVATION ADMIT",
    "Recovery Room": "SURGICAL SAME DAY ADMISSION",
    "Chest Pain Center": "EW EMER.",
    "Acute Care/Floor": "URGENT",
    "PACU": "SURGICAL SAME DAY ADMISSION",
    "Observation": "DIRECT OBSERVATION",
    "ICU": "URGENT",
    "Other": "DIRECT OBSERVATION",
}
ADMISSION_TYPE_IDS = {
    "AMBULATORY OBSERVATION": 1,
    "DIRECT EMER.": 2,
    "DIRECT OBSERVATION": 3,
    "ELECTIVE": 4,
    "EU OBSERVATION": 5,
    "EW EMER.": 6,
    "OBSERVATION ADMIT": 7,
    "SURGICAL SAME DAY ADMISSION": 8,
    "URGENT": 9,
}
GENDERS = {"F": 0, "M": 1}
GENDER_WORDS = {"Female": 0, "Male": 1}
OLDEST = "> 89"
OLDEST_AGE = 90
ADULT_AGE = 18
MINUTES_PER_DAY = 1440


def admission_stays(
    admissions: DataFrame, diagnoses: DataFrame, procedures: DataFrame, stays: DataFrame, patients: DataFrame
) -> DataFrame:
    """One row per surviving admission's earliest stay with its code sets:
    ``hadm_id, icu_los, gender, admission_type, insurance, diagnoses, procedures``.

    Codes are merged into sets before they meet the admission, so diagnoses and
    procedures never multiply. Admissions without either drop out. Simultaneous
    earliest stays with different lengths stay apart."""
    stays = parsed_times(stays, ["intime"])
    first = earliest_records(stays.select("subject_id", "hadm_id", "los", "intime"), "hadm_id", "intime")
    base = (
        first.join(patients.select("subject_id", "gender"), "subject_id")
        .join(
            admissions.filter(F.col("hospital_expire_flag") == 0).select("hadm_id", "admission_type", "insurance"),
            "hadm_id",
        )
        .select(
            "hadm_id",
            F.floor("los").cast("bigint").alias("icu_los"),
            text.lookup("gender", GENDERS).alias("gender"),
            "admission_type",
            "insurance",
        )
        .distinct()
    )
    diagnosis_sets = diagnoses.groupBy("hadm_id").agg(F.collect_set("icd_code").alias("diagnoses"))
    procedure_sets = procedures.groupBy("hadm_id").agg(F.collect_set("icd_code").alias("procedures"))
    return base.join(diagnosis_sets, "hadm_id").join(procedure_sets, "hadm_id")


def all_codes(diagnosis: DataFrame) -> DataFrame:
    """Distinct (patientunitstayid, icd_code, code_type) of lists that mix code systems,
    in one pass; a code of no known system is left out."""
    parts = diagnosis.na.drop(subset=["patientunitstayid", "icd9code"]).select(
        "patientunitstayid", F.explode(text.split_list("icd9code")).alias("code")
    )
    kinds = [F.when(F.col("code").rlike(pattern), F.lit(kind)) for kind, pattern in text.CODE_PATTERNS.items()]
    return (
        parts.select("patientunitstayid", text.without_dots(F.col("code")).alias("icd_code"), F.coalesce(*kinds).alias("code_type"))
        .filter(F.col("code_type").isNotNull())
        .distinct()
    )


def code_rows(diagnosis: DataFrame, code_type: str) -> DataFrame:
    """The codes of one system: distinct (patientunitstayid, icd_code)."""
    return all_codes(diagnosis).filter(F.col("code_type") == code_type).drop("code_type")


def unit_patients(patient: DataFrame) -> DataFrame:
    """Adults discharged alive: ``patientunitstayid, uniquepid, gender,
    admission_type, admission_type_id, icu_los``. Incomplete records are dropped;
    days count from hospital admission to unit discharge, rounded up."""
    columns = [
        "patientunitstayid", "gender", "hospitaladmitsource", "hospitaladmitoffset",
        "unitdischargeoffset", "hospitaldischargestatus", "age", "uniquepid",
    ]
    minutes = F.col("unitdischargeoffset") - F.col("hospitaladmitoffset")
    age = F.when(F.col("age") == OLDEST, F.lit(OLDEST_AGE)).otherwise(F.col("age").cast("int"))
    return (
        patient.select(*columns)
        .na.drop()
        .filter((F.col("hospitaldischargestatus") == "Alive") & (age >= ADULT_AGE))
        .select(
            "patientunitstayid",
            "uniquepid",
            text.lookup("gender", GENDER_WORDS).alias("gender"),
            text.lookup("hospitaladmitsource", ADMISSION_TYPE_OF_SOURCE).alias("admission_type"),
            F.ceil(minutes / MINUTES_PER_DAY).cast("bigint").alias("icu_los"),
        )
        .filter((F.col("icu_los") >= 0) & F.col("gender").isNotNull())
        .withColumn("admission_type_id", text.lookup("admission_type", ADMISSION_TYPE_IDS))
    )


def unit_diagnoses(patient: DataFrame, diagnosis: DataFrame, code_type: str | None = None) -> DataFrame:
    """Patients joined with their codes, one row per code: of one system, or of all with
    their ``code_type``."""
    codes = all_codes(diagnosis) if code_type is None else code_rows(diagnosis, code_type)
    return unit_patients(patient).join(codes, "patientunitstayid")


def unit_stays(patient: DataFrame, diagnosis: DataFrame, code_type: str) -> DataFrame:
    """Patients with the set of their codes, merged before the join."""
    sets = code_rows(diagnosis, code_type).groupBy("patientunitstayid").agg(
        F.collect_set("icd_code").alias("diagnoses")
    )
    return unit_patients(patient).join(sets, "patientunitstayid")


def _tagged(prefix: str, column: str) -> Column:
    return F.transform(column, lambda value: F.concat(F.lit(f"{prefix}="), value))


def stay_transactions(stays: DataFrame) -> DataFrame:
    """Transactions of ``admission_stays`` or ``unit_stays``. Items carry their
    namespace, so codes of different kinds can never be confused."""
    gender = F.when(F.col("gender") == 0, F.lit("gender=female")).when(F.col("gender") == 1, F.lit("gender=male"))
    single = [gender, F.concat(F.lit("admission_type="), "admission_type")]
    if "insurance" in stays.columns:
        single.append(F.concat(F.lit("insurance="), "insurance"))
    lists = [F.array_compact(F.array(*single)), _tagged("diagnose", "diagnoses")]
    if "procedures" in stays.columns:
        lists.append(_tagged("procedure", "procedures"))
    return stays.select(
        F.array_sort(F.concat(*lists)).alias("items"),
        F.col("icu_los").alias("target"),
        F.lit(1).cast("bigint").alias("weight"),
    )


def encoded_stays(stays: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``stays`` (of ``admission_stays``) with ids instead of codes, and the dictionaries
    ``(id, code)`` of insurance, admission_type, procedure and diagnose."""
    stays = materialize(stays, "stays")
    dictionaries, encoded, row = {}, stays, ["hadm_id", "icu_los"]
    for kind in ("insurance", "admission_type"):
        numbered = dictionary.build_dictionary(stays, kind, f"{kind}_id")
        dictionaries[kind] = materialize(numbered, kind).select(f"{kind}_id", kind)
        encoded = dictionary.encode_column(encoded, dictionaries[kind], kind)
    for kind, column in (("procedure", "procedures"), ("diagnose", "diagnoses")):
        codes = stays.select(F.explode(column).alias(kind))
        dictionaries[kind] = materialize(dictionary.build_dictionary(codes, kind, f"{kind}_id"), kind).select(f"{kind}_id", kind)
        encoded = dictionary.encode_sets(encoded, dictionaries[kind], column, row, f"{kind}_ids")
    return encoded, dictionaries


def prepare_admissions(*tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole preparation of the first database: transactions with integer items, and
    the dictionary ``item, item_text`` that decodes them."""
    encoded, dictionaries = encoded_stays(admission_stays(*tables))
    starts = dictionary.namespace_starts(dictionaries)
    return offset_transactions(encoded, starts), dictionary.item_dictionary(dictionaries, starts)


def prepare_units(patient: DataFrame, diagnosis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole preparation of the second database: a row per patient, code and system,
    and the dictionary ``code_type, code_id, icd_code`` numbered from 1 in each system."""
    rows = materialize(unit_diagnoses(patient, diagnosis), "units")
    codes = rows.select("code_type", "icd_code").distinct()
    order = Window.partitionBy("code_type").orderBy("icd_code")
    return rows, codes.select("code_type", F.row_number().over(order).alias("code_id"), "icd_code")


def parsed_times(rows: DataFrame, columns: list[str], pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """``columns`` as timestamps. Text that does not follow ``pattern`` ends the job rather
    than turning into null; nulls stay."""
    return rows.withColumns({c: F.to_timestamp(c, pattern) for c in columns if dict(rows.dtypes)[c] == "string"})


def offset_transactions(encoded_stays: DataFrame, starts: dict[str, int] | None = None) -> DataFrame:
    """Transactions with integer items: ids moved into their namespace's range. With
    the default ``starts`` an id beyond its range ends the job. Expects id columns ``gender, insurance_id, admission_type_id`` and id arrays
    ``procedure_ids, diagnose_ids``; the ids travel as strings."""

    starts = dictionary.OFFSETS if starts is None else starts
    after = [*list(starts.values())[1:], None]
    room = {kind: end and end - start for (kind, start), end in zip(starts.items(), after)}

    def place(value: Column, kind: str) -> Column:
        item = value + starts[kind]
        if room[kind] is None:
            return item
        full = F.raise_error(F.concat(F.lit(f"{kind} id beyond its range: "), value.cast("string"))).cast("int")
        return F.when(value <= room[kind], item).otherwise(F.when(value.isNotNull(), full))

    def moved(column: str, kind: str) -> Column:
        return F.transform(column, lambda i: place(i, kind))

    single = F.array_compact(
        F.array(
            F.col("gender").cast("int"),
            place(F.col("insurance_id"), "insurance"),
            place(F.col("admission_type_id"), "admission_type"),
        )
    )
    items = F.concat(single, moved("procedure_ids", "procedure"), moved("diagnose_ids", "diagnose"))
    return encoded_stays.select(
        items.cast("array<string>").alias("items"),
        F.col("icu_los").alias("target"),
        F.lit(1).cast("bigint").alias("weight"),
    )

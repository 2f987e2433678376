"""Declared schemas of the inputs and of the exchanged tables."""

from __future__ import annotations

ADMISSIONS = "hadm_id bigint, admission_type string, insurance string, hospital_expire_flag int"
CODES = "hadm_id bigint, icd_code string, icd_version int"
STAYS = "subject_id bigint, hadm_id bigint, los double, intime timestamp"
PATIENTS = "subject_id bigint, gender string"
UNIT_PATIENTS = (
    "patientunitstayid bigint, gender string, hospitaladmitsource string, hospitaladmitoffset int, "
    "unitdischargeoffset int, hospitaldischargestatus string, age string, uniquepid string"
)
UNIT_DIAGNOSES = "patientunitstayid bigint, icd9code string"
CODE_MAPPING = "icd_code_dia_id int, icd_code_dia string"
VALUES = "target bigint"
TRANSACTIONS = "items array<string>, target bigint, weight bigint"
RULES = "itemset array<string>, score double, position bigint"
RULE_VALUES = "itemset array<string>, target bigint, n bigint"

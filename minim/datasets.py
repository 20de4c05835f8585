"""The five public tables the reference ships loaders for."""

from __future__ import annotations

from minim.spec import DatasetSpec, register_spec

# Column names, targets and sentinel codes of the published data files.
INCOME = register_spec(DatasetSpec(
    name="income",
    aliases=("acs", "acs_income"),
    features=("AGEP", "COW", "SCHL", "MAR", "OCCP", "POBP", "RELP", "WKHP", "SEX", "RAC1P"),
    qis=("AGEP", "COW", "SCHL", "MAR", "OCCP", "POBP", "RELP", "WKHP", "SEX", "RAC1P"),
    numeric=("AGEP", "WKHP"),
    label="PINCP",
    continuous=("AGEP", "WKHP"),
))

PUBCOV = register_spec(DatasetSpec(
    name="pubcov",
    aliases=("acs_pubcov", "public_coverage", "acs_public_coverage"),
    features=(
        "AGEP", "SCHL", "MAR", "SEX", "DIS", "ESP", "CIT", "MIG", "MIL", "ANC", "NATIVITY",
        "DEAR", "DEYE", "DREM", "PINCP", "ESR", "ST", "FER", "RAC1P",
    ),
    qis=(
        "AGEP", "SCHL", "MAR", "SEX", "DIS", "ESP", "CIT", "MIG", "MIL", "ANC", "NATIVITY",
        "DEAR", "DEYE", "DREM", "PINCP", "ESR", "ST", "FER", "RAC1P",
    ),
    numeric=("AGEP", "PINCP"),
    label="PUBCOV",
    continuous=("AGEP", "PINCP"),
))

BANK = register_spec(DatasetSpec(
    name="bm",
    aliases=("bank", "bank_marketing", "bankmarketing"),
    features=(
        "age", "job", "marital", "education", "default", "balance", "housing", "loan",
        "contact", "day", "month", "duration", "campaign", "pdays", "previous", "poutcome",
    ),
    qis=("age", "job", "marital", "education", "housing", "loan", "month"),
    numeric=("age", "balance", "day", "duration", "campaign", "pdays", "previous"),
    label="y",
    label_values={"no": 0, "yes": 1},
    string_categories=(
        "job", "marital", "education", "default", "housing", "loan", "contact", "month",
        "poutcome",
    ),
    continuous=("age",),
))

CREDIT = register_spec(DatasetSpec(
    name="bng",
    aliases=("credit_g", "bng_credit_g", "bng-credit-g"),
    features=(
        "checking_status", "duration", "credit_history", "purpose", "credit_amount",
        "savings_status", "employment", "installment_commitment", "personal_status",
        "other_parties", "residence_since", "property_magnitude", "age",
        "other_payment_plans", "housing", "existing_credits", "job", "num_dependents",
        "own_telephone", "foreign_worker",
    ),
    qis=(
        "checking_status", "duration", "credit_history", "purpose", "credit_amount",
        "savings_status", "employment", "installment_commitment", "personal_status",
        "other_parties", "residence_since", "property_magnitude", "age",
        "other_payment_plans", "housing", "existing_credits", "job", "num_dependents",
        "own_telephone", "foreign_worker",
    ),
    numeric=(
        "duration", "credit_amount", "installment_commitment", "residence_since", "age",
        "existing_credits", "num_dependents",
    ),
    label="class",
    label_values={"bad": 0, "good": 1},
    string_categories=(
        "checking_status", "credit_history", "purpose", "savings_status", "employment",
        "personal_status", "other_parties", "property_magnitude", "other_payment_plans",
        "housing", "job", "own_telephone", "foreign_worker",
    ),
    continuous=("duration", "credit_amount", "age"),
))

DIABETES = register_spec(DatasetSpec(
    name="diabetes",
    aliases=("diabetes_130_us_hospitals",),
    features=(
        "race", "gender", "age", "weight", "admission_type_id", "discharge_disposition_id",
        "admission_source_id", "time_in_hospital", "payer_code", "medical_specialty",
        "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
        "number_emergency", "number_inpatient", "diag_1", "diag_2", "diag_3",
        "number_diagnoses", "max_glu_serum", "A1Cresult", "metformin", "repaglinide",
        "nateglinide", "chlorpropamide", "glimepiride", "acetohexamide", "glipizide",
        "glyburide", "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose", "miglitol",
        "troglitazone", "tolazamide", "examide", "citoglipton", "insulin",
        "glyburide-metformin", "glipizide-metformin", "glimepiride-pioglitazone",
        "metformin-rosiglitazone", "metformin-pioglitazone", "change", "diabetesMed",
    ),
    qis=(
        "age", "race", "gender", "admission_type_id", "admission_source_id",
        "discharge_disposition_id", "time_in_hospital", "number_outpatient",
        "number_emergency", "number_inpatient", "num_lab_procedures", "num_procedures",
        "num_medications", "payer_code", "medical_specialty", "diag_1", "diag_2", "diag_3",
    ),
    numeric=(
        "time_in_hospital", "number_outpatient", "number_emergency", "number_inpatient",
        "num_lab_procedures", "num_procedures", "num_medications", "number_diagnoses",
    ),
    label="readmitted",
    label_values={"NO": 0, ">30": 1, "<30": 1},
    entity="patient_nbr",
    order_in_entity="encounter_id",
    sentinels={
        "race": ("?",), "gender": ("Unknown/Invalid",), "weight": ("?",),
        "admission_type_id": ("5", "6", "8"), "admission_source_id": ("9", "17", "20"),
        "discharge_disposition_id": ("18", "25"), "payer_code": ("?",),
        "medical_specialty": ("?",), "diag_1": ("?",), "diag_2": ("?",), "diag_3": ("?",),
    },
))

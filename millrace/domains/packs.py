"""Rule packs as data: fields, other spellings of their names, and rules.

A rule line reads: id, layer, severity (e/w/i), fields, check, options. A
schema rule reports missing fields; every other check becomes a Column predicate
(see checks.py) that is true where a row violates it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import codes

SEVERITY = {"e": "error", "w": "warning", "i": "info"}
LAYERS = ("schema", "format", "reference", "business", "semantic")


@dataclass(frozen=True)
class Rule:
    id: str
    layer: str
    severity: str
    fields: tuple[str, ...]
    check: str
    params: dict = field(default_factory=dict)
    repair: str = "flag_only"

    def __post_init__(self) -> None:
        if self.layer not in LAYERS or self.severity not in SEVERITY.values():
            raise ValueError(f"rule {self.id}: unknown layer or severity")


@dataclass(frozen=True)
class Pack:
    name: str
    schema_version: str
    fields: tuple[str, ...]
    required: tuple[str, ...]
    ids: tuple[str, ...]
    spellings: dict[str, tuple[str, ...]]
    rules: tuple[Rule, ...]
    private: tuple[str, ...] = ()


def _rules(table: str, **options: dict) -> tuple[Rule, ...]:
    out = []
    for line in filter(None, (x.strip() for x in table.splitlines())):
        id_, layer, severity, fields, check, *rest = line.split(" | ")
        params = dict(options.get(id_.replace("-", "_"), {}))
        for item in rest:
            key, _, value = item.partition("=")
            params[key] = float(value) if key in ("min", "max", "tolerance") else value
        repair = params.pop("repair", "none" if layer == "schema" else "flag_only")
        out.append(Rule(id_, layer, SEVERITY[severity], tuple(fields.split(", ")), check, params, repair))
    return tuple(out)


def _names(table: str) -> tuple[tuple[str, ...], dict[str, tuple[str, ...]]]:
    """Lines "field: other spellings"; spellings are compared without case, blanks, '-' and '_'."""
    out = {}
    for line in filter(None, (x.strip() for x in table.splitlines())):
        name, _, rest = line.partition(":")
        out[name] = (name, *rest.split())
    return tuple(out), out


_f, _s = _names("""
transaction_id: txn_id trans_id tx_id
date: txn_date transaction_date posting_date value_date
account_code: acct_code gl_account account_no
debit: dr debit_amount
credit: cr credit_amount
currency: ccy curr currency_code
description: memo narration details
entity_id: party_id counterparty_id vendor_id
""")
FINANCE = Pack("finance", "2024-01", _f, ("transaction_id", "date", "debit", "credit", "currency"), ("transaction_id", "entity_id"), _s, _rules("""
FIN-001 | schema | e | transaction_id | not_null
FIN-002 | schema | e | date, debit, credit, currency | not_null
FIN-003 | format | e | date | iso_date | repair=loose_date
FIN-004 | format | e | debit, credit | nonneg_2dp
FIN-005 | reference | e | currency | codes
FIN-006 | business | e | transaction_id, debit, credit | balanced | tolerance=0.01
FIN-007 | business | w | debit, credit | not_both_sided
FIN-008 | format | w | account_code | regex | pattern=[A-Za-z0-9]{4,12}
FIN-009 | semantic | w | date | not_future
""", FIN_005={"codes": codes.ISO4217}))  # fmt: skip

_f, _s = _names("""
gtin: gtin8 gtin12 gtin13 gtin14 upc ean barcode item_gtin
gln: global_location_number
product_description: description prod_desc item_description
brand_name: brand manufacturer
net_content: content net_weight quantity
net_content_uom: uom unit unit_of_measure content_unit
country_of_origin: country origin made_in coo
gpc_brick_code: gpc brick_code
""")
RETAIL = Pack("retail", "2024-01", _f, ("gtin",), ("gtin", "gln"), _s, _rules("""
GS1-001 | schema | e | gtin | not_null
GS1-002 | format | e | gtin | gtin_length | repair=digits
GS1-003 | format | e | gtin | gtin_check
GS1-004 | format | e | gln | gln_check
GS1-005 | reference | e | country_of_origin | codes | set=countries | fold=1
GS1-006 | reference | e | net_content_uom | codes
GS1-007 | format | e | product_description | nonnull_maxlen | max=200
GS1-008 | format | w | gpc_brick_code | regex | pattern=[0-9]{8}
GS1-009 | business | w | net_content, net_content_uom | content_uom
""", GS1_006={"codes": codes.UOM}))  # fmt: skip

_ids = ("stop_id", "route_id", "trip_id")
_STOPS = """
GTFS-S001 | schema | e | stop_id, stop_lat, stop_lon | not_null
GTFS-S002 | format | e | stop_lat | range | min=-90 | max=90
GTFS-S003 | format | e | stop_lon | range | min=-180 | max=180
GTFS-S004 | business | e | stop_id | unique
"""
_ROUTES = """
GTFS-R001 | schema | e | route_id, route_type | not_null
GTFS-R002 | reference | e | route_type | number_in
GTFS-R003 | business | e | route_id | unique
"""
_TRIPS = """
GTFS-T001 | schema | e | route_id, service_id, trip_id | not_null
GTFS-T002 | business | e | trip_id | unique
GTFS-T003 | reference | e | route_id | sibling | file=routes | target=route_id
"""
_STOP_TIMES = """
GTFS-ST001 | schema | e | trip_id, arrival_time, departure_time, stop_id, stop_sequence | required
GTFS-ST002 | format | e | arrival_time, departure_time | gtfs_time
GTFS-ST003 | business | e | arrival_time, departure_time | departure_after_arrival
GTFS-ST004 | business | e | trip_id, stop_sequence | rising
"""
_gtfs = lambda name, fields, table: Pack("transport", "gtfs-2024", fields, (), _ids, {f: (f,) for f in fields}, _rules(table, GTFS_R002={"values": codes.ROUTE_TYPES}))
TRANSPORT = {
    "stops": _gtfs("stops", ("stop_id", "stop_name", "stop_lat", "stop_lon"), _STOPS),
    "routes": _gtfs("routes", ("route_id", "route_short_name", "route_long_name", "route_type"), _ROUTES),
    "trips": _gtfs("trips", ("route_id", "service_id", "trip_id"), _TRIPS),
    "stop_times": _gtfs("stop_times", ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"), _STOP_TIMES),
}

_SYSTEMS = ("http://loinc.org", "http://snomed.info/sct", "http://hl7.org/fhir/sid/icd-10")
_f, _s = _names("""
patient_id: pat_id subject_id mrn
birth_date: dob date_of_birth
gender: sex administrative_gender
deceased: deceased_boolean is_deceased
deceased_date: deceased_datetime death_date date_of_death
marital_status: marital
address_postal_code: postal_code zip zip_code postcode
address_country: country
""")
PATIENT = Pack("healthcare", "fhir-r4-patient", _f, ("patient_id", "birth_date", "gender"), ("patient_id",), _s, _rules("""
HC-P001 | schema | e | patient_id | not_null
HC-P002 | schema | e | birth_date, gender | not_null
HC-P003 | format | e | birth_date | fhir_date
HC-P003I | format | i | birth_date | partial_date
HC-P004 | format | e | birth_date | not_future
HC-P005 | reference | e | gender | codes | repair=code_case
HC-P006 | business | e | deceased_date, birth_date | deceased_after_birth
HC-P007 | business | e | deceased_date | not_future
HC-P008 | reference | e | address_country | codes | set=countries | fold=1
HC-P009 | semantic | w | birth_date | age
""", HC_P005={"codes": codes.GENDER}), private=("patient_id", "birth_date", "address_postal_code"))  # fmt: skip
_f, _s = _names("""
observation_id: obs_id
patient_id: subject_id subject_reference
status: observation_status
code_system: system code_coding_system
code_value: code loinc_code observation_code
display: code_display label
effective_date: effective_datetime effective observation_date
value_quantity: value_number numeric_value
value_unit: unit
value_string: value_text text_value
interpretation: interpretation_code abnormal_flag
""")
OBSERVATION = Pack("healthcare", "fhir-r4-observation", _f, ("observation_id", "patient_id", "status", "code_value"), ("observation_id", "patient_id"), _s, _rules("""
HC-O001 | schema | e | observation_id, patient_id, status, code_value | not_null
HC-O002 | reference | e | status | codes
HC-O003 | reference | w | code_system | codes
HC-O004 | reference | w | code_value | loinc
HC-O005 | format | e | effective_date | iso_datetime
HC-O008 | format | e | value_quantity | nonneg_number
HC-O006 | business | w | value_quantity | at_least_one | others=value_string
HC-O007 | business | e | value_quantity | requires | other=value_unit
HC-O009 | reference | e | interpretation | codes
""", HC_O002={"codes": codes.OBSERVATION_STATUS}, HC_O003={"codes": _SYSTEMS}, HC_O009={"codes": ("H", "L", "N", "A", "AA", "HH", "LL", "U", "R", "S", "I")}), private=("patient_id",))  # fmt: skip
_f, _s = _names("""
encounter_id: enc_id visit_id
patient_id: subject_id subject_reference
status: encounter_status
class_code: class encounter_class
period_start: start_date admit_date start
period_end: end_date discharge_date end
reason_code: reason
reason_code_system: reason_system
hospitalization_admit_source: admit_source
service_type: service
""")
_CLASSES = ("AMB", "EMER", "FLD", "HH", "IMP", "ACUTE", "NONAC", "OBSENC", "PRENC", "SS", "VR")
ENCOUNTER = Pack("healthcare", "fhir-r4-encounter", _f, ("encounter_id", "patient_id", "status"), ("encounter_id", "patient_id"), _s, _rules("""
HC-E001 | schema | e | encounter_id, patient_id, status | not_null
HC-E002 | reference | e | status | codes
HC-E003 | reference | e | class_code | codes
HC-E004 | format | e | period_start, period_end | iso_datetime
HC-E005 | business | e | period_end, period_start | not_before
HC-E006 | business | e | period_start, period_end | not_future_when_finished
HC-E007 | reference | w | reason_code_system | codes
HC-E008 | semantic | w | period_start, period_end | under_a_year_when_finished
""", HC_E002={"codes": codes.ENCOUNTER_STATUS}, HC_E003={"codes": _CLASSES}, HC_E007={"codes": _SYSTEMS}), private=("patient_id",))  # fmt: skip
HEALTHCARE = {"Patient": PATIENT, "Observation": OBSERVATION, "Encounter": ENCOUNTER}

_f, _s = _names("""
student_unique_id: student_id stu_id
school_id: school_code
school_year: academic_year sy
grade_level: grade grade_level_descriptor
enrollment_date: entry_date enroll_date
exit_withdrawal_date: exit_date withdrawal_date
exit_withdrawal_type: exit_type withdrawal_type
assessment_title: assessment_name test_name
assessment_score: score test_score
assessment_score_type: score_type reporting_method
performance_level: proficiency perf_level
staff_unique_id: staff_id teacher_id
staff_classification: staff_type staff_role
""")
#: Classes of school staff.
_STAFF = ("Librarians/Media specialists", "Paraprofessionals/Instructional assistants", "Student support services staff", "Administrative support staff", "Principals/Assistant principals", "School administrators", "LEA administrators", "Instructional coordinators", "Teachers")
EDUCATION = Pack("education", "ed-fi-2024", _f, ("student_unique_id", "school_id", "school_year"), ("student_unique_id", "staff_unique_id"), _s, _rules("""
ED-001 | schema | e | student_unique_id | not_null
ED-002 | schema | e | school_id, school_year | not_null
ED-003 | format | e | school_year | year_to | ahead=2
ED-004 | reference | e | grade_level | codes | fold=1
ED-005 | format | e | enrollment_date | iso_date
ED-006 | format | e | exit_withdrawal_date | iso_date
ED-007 | business | e | exit_withdrawal_date, enrollment_date | not_before
ED-008 | business | w | enrollment_date, school_year | in_school_year
ED-009 | reference | e | exit_withdrawal_type | codes | fold=1
ED-010 | business | e | exit_withdrawal_date | requires | other=exit_withdrawal_type
ED-011 | schema | e | assessment_title, assessment_score | both_present
ED-012 | format | e | assessment_score | numeric
ED-013 | reference | w | assessment_score_type | codes | fold=1
ED-014 | semantic | w | assessment_score | not_negative
ED-016 | reference | e | staff_classification | codes | fold=1
""", ED_004={"codes": codes.GRADE_LEVELS}, ED_009={"codes": codes.EXIT_TYPES}, ED_013={"codes": codes.SCORE_TYPES}, ED_016={"codes": _STAFF}), private=("student_unique_id", "staff_unique_id"))  # fmt: skip

_f, _s = _names("""
field_id: field_identifier
operation_id: op_id
operation_type: op_type activity_type
operation_date: op_date activity_date date
crop_type: crop_name crop
crop_code: fao_code crop_id
area: field_area size
area_unit: area_uom
yield_value: yield yield_amount
yield_unit: yield_uom
soil_texture_class: soil_texture texture_class
soil_ph: ph
soil_om_pct: soil_om organic_matter_pct om_pct
equipment_id: machine_id implement_id
operator_id: driver_id
season_year: crop_year harvest_year
""")
AGRICULTURE = Pack("agriculture", "adapt-2024", _f, ("field_id",), ("field_id", "operation_id", "equipment_id", "operator_id"), _s, _rules("""
AG-001 | schema | e | field_id | not_null
AG-002 | format | e | operation_date | iso_date
AG-003 | format | e | operation_date | not_future
AG-004 | reference | e | operation_type | codes | fold=1
AG-005 | reference | w | crop_code | codes
AG-006 | format | e | area | positive
AG-007 | reference | e | area_unit | codes | repair=unit
AG-008 | business | e | area, area_unit | both_present
AG-009 | format | e | yield_value | positive
AG-010 | reference | e | yield_unit | codes | repair=unit
AG-011 | business | e | yield_value, yield_unit | both_present
AG-012 | business | w | yield_value | only_when_harvest
AG-013 | reference | e | soil_texture_class | codes | fold=1
AG-014 | format | e | soil_ph | range | min=0 | max=14
AG-015 | semantic | w | soil_ph | range | min=3.5 | max=9.5
AG-016 | format | e | soil_om_pct | range | min=0 | max=100
AG-017 | semantic | w | soil_om_pct | range | max=20
AG-018 | format | e | season_year | year_to | ahead=1
AG-019 | business | w | operation_date, season_year | year_matches
""", AG_004={"codes": codes.OPERATIONS}, AG_005={"codes": codes.CROPS}, AG_007={"codes": codes.AREA_UNITS, "spellings": codes.AREA_SPELLINGS}, AG_010={"codes": codes.YIELD_UNITS, "spellings": codes.YIELD_SPELLINGS}, AG_013={"codes": codes.SOIL_TEXTURES}))  # fmt: skip

_f, _s = _names("""
eidr_id: eidr content_id
title: name
content_type: type referent_type
release_date: date
country_of_origin: country origin_country
language: lang original_language
runtime_seconds: runtime duration_seconds
distributor_id: distributor
series_eidr_id: series_id parent_eidr_id
season_number: season
episode_number: episode
""")
CONTENT = Pack("media", "eidr-ddex-2024", _f, ("eidr_id",), ("eidr_id", "distributor_id"), _s, _rules("""
MD-C001 | schema | e | eidr_id | not_null
MD-C002 | format | e | eidr_id | eidr
MD-C003 | reference | e | content_type | codes
MD-C004 | format | e | release_date | iso_or_partial
MD-C005 | reference | e | country_of_origin | codes | set=countries | fold=1
MD-C006 | reference | e | language | codes
MD-C007 | format | e | runtime_seconds | positive_integer
MD-C008 | semantic | w | runtime_seconds | range | max=86400
MD-C009 | business | e | content_type | requires_when | equals=Episode | other=series_eidr_id
MD-C010 | business | e | series_eidr_id | eidr
MD-C011 | business | e | season_number, episode_number | positive_integer
MD-C012 | business | e | episode_number | requires | other=season_number
MD-C013 | business | w | content_type | no_episode_of_movie
""", MD_C003={"codes": codes.EIDR_TYPES}, MD_C006={"codes": codes.ISO639}))  # fmt: skip
_f, _s = _names("""
release_id: ddex_release_id
icpn: upc ean barcode
release_type: type
title: release_title name
language: lang
label_name: label record_label
artist_name: artist main_artist
party_id: contributor_id
party_role: role contributor_role
territory: territory_code region
release_date: date
price_tier: price
track_count: tracks number_of_tracks
""")
RELEASE = Pack("media", "eidr-ddex-2024", _f, ("release_id",), ("release_id", "party_id"), _s, _rules("""
MD-R001 | schema | e | release_id | not_null
MD-R002 | format | e | icpn | icpn
MD-R003 | reference | e | release_type | codes
MD-R004 | reference | e | language | codes
MD-R005 | reference | e | party_role | codes
MD-R006 | reference | e | territory | codes | set=territories | fold=1
MD-R007 | format | e | release_date | iso_date
MD-R008 | format | e | track_count | positive_integer
MD-R009 | semantic | w | track_count | range | max=500
MD-R010 | business | e | party_role | requires | other=party_id
MD-R011 | business | w | track_count | single_tracks
""", MD_R003={"codes": codes.DDEX_RELEASES}, MD_R004={"codes": codes.ISO639}, MD_R005={"codes": codes.DDEX_ROLES}))  # fmt: skip
MEDIA = {"content": CONTENT, "release": RELEASE}
#: Fields that tell resources apart: one of them shows the resource.
SIGNALS = {
    "Patient": ("birth_date", "gender", "marital_status", "deceased", "deceased_date", "address_postal_code"),
    "Observation": ("observation_id", "code_value", "code_system", "value_quantity", "value_string", "interpretation"),
    "Encounter": ("encounter_id", "class_code", "period_start", "period_end", "service_type"),
    "content": ("eidr_id", "runtime_seconds", "series_eidr_id", "season_number", "episode_number"),
    "release": ("release_id", "icpn", "track_count", "party_role", "label_name", "artist_name"),
}
SINGLE = {p.name: p for p in (FINANCE, RETAIL, EDUCATION, AGRICULTURE)}

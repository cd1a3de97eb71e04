"""Schemas of the stored relations."""

from __future__ import annotations

CATALOGUE = ("adc_id string, adc_name string, aliases string, target string, antibody string, linker_name string, linker_type string, "
             "payload_name string, payload_class string, dar double, indication string, development_status string, company string, "
             "source_url string, data_review_status string")
TRIAL = ("nct_id string, brief_title string, official_title string, overall_status string, phases array<string>, conditions array<string>, "
         "interventions array<string>, sponsor string, enrollment bigint, start_date string, completion_date string, last_update_date string, "
         "primary_outcomes array<string>, source_url string")
PUBLICATION = ("document_id string, source string, source_record_id string, title string, abstract string, authors array<string>, journal string, "
               "publication_date string, doi string, source_url string")
OBSERVATION = ("subject_type string, subject_id string, predicate string, source string, source_record_id string, observed_at string, source_url string, "
               "snapshot_id string, confidence double, extractor string, review_status string, seq bigint, "
               "values array<struct<value_json:string,display_value:string,source_locator:string,evidence_text:string>>")
RUN = ("run_id string, source string, started_at timestamp, finished_at timestamp, status string, attempts int, expected_count bigint, "
       "collected_count bigint, is_complete boolean, error_text string, planned_truncation boolean")
MEMBER = "run_id string, source string, source_record_id string"
SNAPSHOT = ("snapshot_id string, source string, source_record_id string, fetched_at string, source_updated_at string, source_url string, "
            "raw_path string, content_hash string, dataset_version string, parser_version string")
STUDY_PAGE = (
    "nextPageToken string, totalCount bigint, studies array<struct<protocolSection:struct<"
    "identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,"
    "statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,completionDateStruct:struct<date:string>,"
    "lastUpdatePostDateStruct:struct<date:string>>,"
    "designModule:struct<phases:array<string>,enrollmentInfo:struct<count:bigint>>,conditionsModule:struct<conditions:array<string>>,"
    "armsInterventionsModule:struct<interventions:array<struct<name:string,otherNames:array<string>>>>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,outcomesModule:struct<primaryOutcomes:array<struct<measure:string>>>>>>")
QUESTION = ("question_id string, split string, category string, question string, expected_route string, expected_status array<string>, "
            "should_refuse boolean, allow_partial boolean, risk_level string, review_status string, adc_id string, expected_document_ids array<string>, "
            "expected_adc_ids array<string>, expected_predicates array<string>, expected_nct_ids array<string>, required_terms array<string>, "
            "evaluation_use string")

"""Schemas of the nested inputs, as DDL."""

ENTITY = "struct<type:string,count:bigint,sensitivity_tier:string,weight:bigint,contribution:bigint>"
REQUEST = ("struct<user_id:string,user_name:string,department:string,platform:string,file_name:string,"
           "file_type:string,file_department:string,api_action:string,geo_location:string,"
           "activity_rate_per_hour:double>")
PII_DETECTION = ("struct<engine:string,branch:string,ocr_confidence:string,high_count:bigint,"
                 "medium_count:bigint,low_count:bigint,sensitivity_score:bigint,risk_category:string,"
                 f"processing_ms:double,entities_detected:array<{ENTITY}>>")
ENFORCEMENT = "struct<action:string,reason:string>"
_EVENT = (("event_id", "string"), ("timestamp", "string"), ("event_type", "string"), ("module", "string"),
          ("request", REQUEST), ("pii_detection", PII_DETECTION), ("enforcement", ENFORCEMENT))
EVENT_FIELDS = ",".join(f"{n}:{t}" for n, t in _EVENT)           # inside a struct
EVENT = ", ".join(f"{n} {t}" for n, t in _EVENT)                 # as a table
METADATA = ("struct<run_id:string,start_time:string,end_time:string,saas_platforms:array<string>,"
            "users_monitored:bigint,total_events:bigint,pii_branches:array<string>,"
            "anomaly_engines:array<string>>")
TRUTH = ("struct<doc_id:string,category:string,file_type:string,path:string,"
         "file_name:string,text:string,entities:array<struct<type:string,value:string>>,"
         "high_entities:bigint,medium_entities:bigint,low_entities:bigint,font:string,"
         "user_id:string,user_name:string,department:string,platform:string,timestamp:string>")
EVENTS_DOCUMENT = f"log_metadata {METADATA}, events array<struct<{EVENT_FIELDS}>>, _corrupt string"     # as one row
GROUND_TRUTH = f"documents array<{TRUTH}>"

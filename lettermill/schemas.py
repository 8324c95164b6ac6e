"""Schemas of the archive's tables, as DDL. Readers give them explicitly; columns added later have defaults."""

from __future__ import annotations

ENVELOPES = (
    "id bigint, account_id bigint, mailbox_id bigint, uid bigint, subject string, text string, `from` string, to array<string>, cc array<string>, bcc array<string>, "
    "date bigint, internal_date bigint, size bigint, thread_id bigint, message_id string, attachments array<string>, has_attachment boolean, tags array<string>"
)
RAW = "id bigint, account_id bigint, mailbox_id bigint, eml binary"
LANDING = "account_id bigint, mailbox string, uid bigint, internal_date bigint, size bigint, body binary, seq bigint"
MAILBOXES = "account_id bigint, id bigint, name string, delimiter string, attributes array<struct<attr:string,extension:string>>, exists bigint, uid_validity bigint"
ACCOUNTS = "id bigint, email string, enabled boolean, created_by bigint, created_at bigint, sync_interval_min int"
SYNC_STATE = "account_id bigint, initial_start bigint, initial_end bigint, initial_failed bigint, last_start bigint, progress map<string,struct<total_batches:int,current_batch:int>>, errors array<struct<error:string,at:bigint>>"
USERS = "id bigint, username string, email string, global_roles array<bigint>, account_access_map map<bigint,bigint>"
ROLES = "id bigint, name string, kind string, permissions array<string>"
ATTACHMENTS = "id bigint, ordinal int, filename string, mime string, inline boolean, content_id string, size bigint, data binary, error string"

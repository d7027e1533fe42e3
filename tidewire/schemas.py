"""Row types of the messages, the state tables and the configuration document.

Timestamps are UTC wall clocks (``timestamp_ntz``), so results do not depend on the session zone.
"""

PEER = "struct<user_id: bigint, channel_id: bigint, raw: string>"

RAW_MESSAGE = f"""
    message_id bigint,
    channel string,
    date timestamp_ntz,
    text string,
    post_author string,
    from_id {PEER},
    sender struct<username: string, first_name: string, last_name: string, title: string>,
    forward struct<from_name: string, from_id: {PEER}, channel_id: bigint,
                   chat: struct<id: bigint, title: string>>,
    media struct<kind: string, mime_type: string,
                 webpage: struct<url: string, description: string>,
                 attribute_urls: array<string>>,
    entities array<struct<type: string, offset: int, length: int, url: string>>
"""

LEDGER = "channel string, message_id bigint, processed_at timestamp_ntz"

TRACKER = "channel string, last_id bigint, updated_at timestamp_ntz"

KEYWORDS = "country_code string, class string, pos int, arity int, kw_en string, kw_ar string"

SHEET = "country_code string, sheet string, row_index bigint, cells array<string>"

CONFIG = """
    DATA_RETENTION_DAYS int,
    TELEGRAM_CONFIG struct<FETCH_INTERVAL_SECONDS: int, FETCH_MESSAGE_LIMIT: int>,
    TELEGRAM_EXCEL_FIELDS array<string>,
    EXCLUDED_TEAMS_FIELDS array<string>,
    EXCLUDED_SHAREPOINT_FIELDS array<string>,
    COUNTRIES map<string, struct<
        name: string,
        channels: array<string>,
        teams_webhook: string,
        teams_channel_name: string,
        sharepoint_config: struct<site_name: string, folder_path: string, file_name: string,
                                  significant_sheet: string, trivial_sheet: string>,
        message_filtering: struct<
            use_ai_for_message_filtering: boolean,
            use_ai_for_enhanced_filtering: boolean,
            translate_trivial_msgs: boolean,
            use_ai_for_translation: boolean,
            significant_keywords: array<variant>,
            trivial_keywords: array<variant>,
            exclude_keywords: array<variant>,
            additional_ai_criteria: array<string>>>>
"""

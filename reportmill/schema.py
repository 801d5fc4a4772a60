"""Schemas of the tables that the engine keeps."""

REPORTS = (
    "report_id string, report_type string, report_date string, report_dt date, target_name string, title string, broker string, file_name string, is_embedded boolean"
)
PARENTS = "parent_id string, parent_index int, content string, file_name string, metadata string"
CHUNKS = "chunk_id string, parent_id string, child_index int, file_name string, target_name string, title string, report_date string, broker string, h1 string, h2 string, h3 string, text string"
HISTORY = "thread_id string, seq long, role string, text string"
LISTING = "category string, pos long, report_type string, target_name string, title string, broker string, pdf_url string, report_dt date"
PRICES = "ticker string, trade_date date, open double, high double, low double, close double, volume long"
SYMBOLS = "name string, code string"

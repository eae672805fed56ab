"""Schemas of the stored tables and of the payloads they are read from."""

from __future__ import annotations

# Stored tables, as DDL. Amounts are decimal(15,2); a null upper bound is an open band.
TABLES = {
    "members": "id long, bioguide_id string, first_name string, last_name string, chamber string, party string, state string, district string, in_office boolean, start_date timestamp_ntz, anomaly_count int, disclosure_count int",
    "disclosures": "id long, member_id long, filing_year int, filing_type string, filing_date timestamp_ntz, document_id string, document_url string, is_ptr boolean, parsed boolean, parse_error string, parse_confidence double, parse_warnings string, has_text_layer boolean",
    "assets": "id long, disclosure_id long, asset_type string, description string, ticker string, value_min decimal(15,2), value_max decimal(15,2), income_min decimal(15,2), income_max decimal(15,2), income_type string",
    "transactions": "id long, disclosure_id long, transaction_date timestamp_ntz, transaction_type string, description string, ticker string, amount_min decimal(15,2), amount_max decimal(15,2), owner string, filing_status string, notification_date timestamp_ntz, filer_comment string",
    "liabilities": "id long, disclosure_id long, creditor string, description string, liability_type string, amount_min decimal(15,2), amount_max decimal(15,2)",
    "travel_payments": "id long, disclosure_id long, source string, start_date timestamp_ntz, end_date timestamp_ntz, itinerary string, days_at_own_expense int",
    "anomalies": "id long, member_id long, anomaly_type string, severity string, title string, description string, disclosure_id long, transaction_id long, computed_value decimal(15,2), threshold_value decimal(15,2), percentile_rank double, p_value double, q_value double, detected_at timestamp_ntz, reviewed boolean",
    "committee_assignments": "id long, member_id long, committee_id string, committee_name string, chamber string, is_subcommittee boolean, parent_committee_id string, title string, rank int, party string",
    "campaign_donations": "id long, member_id long, ticker string, donor_name string, amount decimal(15,2), cycle string, transaction_type string, donation_date timestamp_ntz, source string, external_id string",
    "lobbying_disclosures": "id long, ticker string, registrant string, client string, amount decimal(15,2), filed_date timestamp_ntz, issue_codes string, source string, external_id string",
    "government_contracts": "id long, ticker string, agency string, description string, amount decimal(15,2), awarded_date timestamp_ntz, end_date timestamp_ntz, source string, external_id string",
    "bills": "id long, congress int, bill_type string, number string, title string, policy_area string, origin_chamber string, introduced_date timestamp_ntz, latest_action_date timestamp_ntz, latest_action_text string, committees_fetched boolean",
    "bill_sponsorships": "id long, bill_id long, member_id long, is_sponsor boolean",
    "bill_committees": "id long, bill_id long, committee_id string, committee_name string, chamber string, activity string, activity_date timestamp_ntz",
    "company_industries": "id long, ticker string, cik int, sic string, sic_description string, company_name string, sector string",
}

# Payloads.
HOUSE_MEMBER = "Prefix string, Last string, First string, Suffix string, FilingType string, StateDst string, Year string, FilingDate string, DocID string"
SENATE_SEARCH = "recordsTotal int, data array<array<string>>"
ROSTER = "id struct<bioguide: string, fec: array<string>>, name struct<first: string, last: string>, terms array<struct<type: string, start: string, end: string, state: string, district: string, party: string>>"
RECEIPTS = "results array<struct<committee_id: string, contributor_name: string, contributor_id: string, contribution_receipt_amount: double, contribution_receipt_date: string, entity_type: string, receipt_type_desc: string, memo_code: string, sub_id: string>>"
LOBBYING = "results array<struct<filing_uuid: string, income: string, expenses: string, dt_posted: string, registrant: struct<name: string>, client: struct<name: string>, lobbying_activities: array<struct<general_issue_code: string>>>>"
AWARDS = "results array<struct<`Award ID`: string, Mod: string, `Recipient Name`: string, `Transaction Amount`: double, `Action Date`: string, `Awarding Agency`: string, `Transaction Description`: string>>"
BILLS = "congress int, type string, number string, title string, policyArea struct<name: string>, introducedDate string, latestAction struct<actionDate: string, text: string>, originChamber string"
ACTIVITY = "array<struct<date: string, name: string>>"
REFERRALS = f"committees array<struct<activities: {ACTIVITY}, chamber: string, name: string, systemCode: string, subcommittees: array<struct<activities: {ACTIVITY}, name: string, systemCode: string>>>>"

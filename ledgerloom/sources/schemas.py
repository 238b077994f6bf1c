"""Schemas of the archive's tables and of the metadata document."""

from __future__ import annotations

AMOUNT_SCALE = 18
AMOUNT = f"decimal(38,{AMOUNT_SCALE})"

_PARTY = "struct<currency:string,issuer:string,value:string>"
_FIELDS = (
    "struct<Account:string,MPTokenIssuanceID:string,MPTAmount:string,Flags:bigint,Sequence:bigint,"
    f"Balance:string,LowLimit:{_PARTY},HighLimit:{_PARTY}>"
)
#: Balance is a string in some entries and an object in others; as STRING it keeps the raw text of either.
META = (
    "struct<TransactionIndex:int,TransactionResult:string,AffectedNodes:array<map<string,struct<"
    f"LedgerEntryType:string,LedgerIndex:string,FinalFields:{_FIELDS},NewFields:{_FIELDS},"
    "PreviousFields:struct<MPTAmount:string,Balance:string>>>>>"
)

TABLES = {
    "issuances": "issuance_id long, kind string, mpt_issuance_id string, currency string, issuer_account string, enabled boolean",
    "transactions": "hash string, ledger_index long, tx_index long, tx_type string, meta_json string",
    "balance_deltas": f"hash string, ledger_index long, address string, issuance_id long, delta {AMOUNT}",
    "account_issuance": "address string, issuance_id long, discovered_via string, first_acquisition_ledger long",
    "account_transactions": "hash string, address string",
    "coverage": "address string, from_ledger long, to_ledger long, reason string",
    "ledgers": "ledger_index long, close_time timestamp",
    "tail": "seq long, type string, validated boolean, ledger_index long, ledger_time long, hash string, tx_type string, accounts array<string>, meta_json string",
}

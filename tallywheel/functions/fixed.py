"""Values that must be as they are for right results (fixed values)."""

TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SELECTOR = "0xa9059cbb"
TRANSFER_FROM_SELECTOR = "0x23b872dd"

TOKEN = "0x514910771af9ca656af840dff83e8264ecf986ca"
RESERVES = "0x5680681ed3767b96914ce741a308155c7fb9171d"
FEE_AGGREGATOR = "0xd6e39d42acee7abcc460e6ea78a0844a0980e78f"
SWAP_AUTOMATOR = "0x36e827ba2b270535ca1b099a6ba2b280ddc0315e"
PA_ROLES = {RESERVES: "pa_reserves", FEE_AGGREGATOR: "pa_fee_aggregator", SWAP_AUTOMATOR: "pa_swap_automator"}

#: Event names to action kinds.
STAKING_KINDS = {
    "Staked": "stake",
    "Stake": "stake",
    "UnstakeRequested": "unstake_requested",
    "UnbondingPeriodStarted": "unstake_requested",
    "Unstaked": "unstake_finalized",
    "UnstakeFinalized": "unstake_finalized",
    "Withdrawn": "unstake_finalized",
    "RewardClaimed": "reward_claimed",
    "RewardsClaimed": "reward_claimed",
    "RewardAdded": "reward_accrued",
    "RewardAccrued": "reward_accrued",
    "Slashed": "slashed",
    "Migrated": "migrated_from_v01",
    "MigratedFromV01": "migrated_from_v01",
    "PoolConfigChanged": "pool_config_changed",
    "ConfigSet": "pool_config_changed",
}
PA_KINDS = {
    "FeeReceived": "pa_fee_received",
    "FeesReceived": "pa_fee_received",
    "FeeAggregated": "pa_fee_received",
    "SwapExecuted": "pa_swap_executed",
    "Swap": "pa_swap_executed",
    "Deposited": "pa_reserves_deposit",
    "ReservesDeposit": "pa_reserves_deposit",
    "Withdrawn": "pa_reserves_deposit",
    "ServiceFeeForwarded": "pa_service_fee_forwarded",
    "Forwarded": "pa_service_fee_forwarded",
    "ConfigSet": "pa_config_changed",
    "ConfigUpdated": "pa_config_changed",
}
#: Parameter names that hold an amount or a wallet, in the order they are tried.
AMOUNT_NAMES = ["amount", "value", "newPrincipal", "principal", "reward", "slashedAmount", "slashedPrincipal", "rewardAmount", "stakedAmount", "withdrawnAmount"]
WALLET_NAMES = ["staker", "wallet", "user", "operator", "account", "from"]

#: Fee services by the address that pays.
SERVICES = {
    "0x271682deb8c4e0901d1a1550ad2e64d568e69909": "vrf",
    "0x65dcc24f8ff9e51f10dcc7ed1e4e2a61e6e14bd6": "functions",
    "0x80226fc0ee2b096224eeac085bb9a8cba1146f7d": "ccip",
    "0x0000000000000000000000000000000000000001": "data_streams",
}

STATUSES = ["unmatched", "unexpected", "ambiguous", "partial", "not_expected", "exact"]  # the worst first
NO_MOVEMENT_KINDS = ["unstake_requested", "reward_accrued", "pool_config_changed"]
YEAR_SECONDS = 31_536_000
FINALITY_DEPTH, OVERLAP_BLOCKS = 64, 50

#: What edges say; {} is a kind, a number or two of them.
REASONS = {
    "idle": "{} has no expected token movement",
    "none": "no movements in tx for this action",
    "exact": "exact amount match",
    "ambiguous": "{} movements match action amount; requires manual disambiguation",
    "partial": "batched movement {}/{}",
    "no_sum": "no subset of {} movements sums to {}",
    "unexpected": "movement with no matching action",
    "pa_idle": "{} has no expected movement",
    "pa_none": "no PA movement with matching amount",
    "pa_exact": "PA action amount matches token movement",
}

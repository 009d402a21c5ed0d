"""DataFrame transforms for directories, referrals, activity logs, matching, changes of state and audits."""

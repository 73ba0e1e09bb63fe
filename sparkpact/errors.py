"""The error of a contract that is declared or used wrongly. It is raised while a plan is built, never for a row."""


class ContractError(Exception):
    pass

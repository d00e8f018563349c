"""What a study fixes before it runs: its code sets and its windows."""

from dataclasses import dataclass

from phasewise import names


@dataclass(frozen=True)
class CodeSets:
    """Names of the code sets by role."""

    diagnosis: str
    antibody_tests: str
    pcr_ag_tests: str = names.SET_PCR_AG_TESTS
    positive_results: str = names.SET_POSITIVE
    negative_results: str = names.SET_NEGATIVE
    ed_visits: str = names.SET_ED
    deceased: str = names.SET_DECEASED
    hospice: str = names.SET_HOSPICE
    bmi: str = names.SET_BMI
    weight: str = names.SET_WEIGHT
    height: str = names.SET_HEIGHT

    def roles(self) -> dict[str, str]:
        """Set name by the role column that operators read."""
        return {
            "diagnosis": self.diagnosis,
            "pcr_ag": self.pcr_ag_tests,
            "antibody": self.antibody_tests,
            "positive_result": self.positive_results,
            "negative_result": self.negative_results,
            "bmi": self.bmi,
            "weight": self.weight,
            "height": self.height,
            "ed_visit": self.ed_visits,
            "deceased": self.deceased,
            "hospice": self.hospice,
        }


@dataclass(frozen=True)
class Windows:
    """Day windows and date limits; ``as_of`` stands in for a clock (C4)."""

    as_of: str
    floor: str = names.FLOOR_DATE
    horizon_days: int = names.HORIZON_DAYS
    link_mode: str = "and"
    link_days: tuple[int, int] = names.LINK_DAYS
    reinfection_wait: int = names.REINFECTION_WAIT_DAYS
    death_window: int = names.DEATH_WINDOW_DAYS
    sample: float = 1.0
    seed: int = names.SAMPLE_SEED
    dose_columns: tuple[str, ...] = tuple(names.DOSE_DATES)
